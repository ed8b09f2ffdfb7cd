"""Near copies by SimHash partitions and exact Jaccard similarity of word shingles: the filter behind the corpus pipeline.

Two texts link if the sets of their shingles have a Jaccard similarity of `similarity` or more. Candidates come from SimHash by the generalised pigeonhole
principle, as in simhash.py, at the distance that such a similarity needs: 64-bit fingerprints of a pair at 0.8 differ by 9.7 bits on average and by more than DISTANCE in
one of ten thousand. Thresholds t_i of the partitions of bits are allocated for that distance, and each text probes, in each partition, all keys within t_i flips. What is within
DISTANCE there is compared on WIDE_BITS bits, which tell pairs of some similarity from chance; then whole sets decide, so no pair below the bound links.

So many flips are too many to shuffle. Texts are dealt by the size of their sets instead (sizes of linked sets differ by the bound at most), and flips are probed where texts meet; a large
group is dealt into blocks that meet two by two, as many as keep copies of a row few. Equal sets are one vertex from the start. Candidates' components are verified set by set, large ones in blocks again. Components of links are those of
simhash.components.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import group_key, kept
from millrace.llm.simhash import BITS, _flips, _unite, block_pairs, components, partitions, shingle_hashes, whole_buckets

#: Bits that may differ of the 64 that are probed, and of the WIDE_BITS that are compared after that: measured for similarities of 0.8 and more.
DISTANCE, WIDE_BITS, WIDE_DISTANCE = 21, 256, 72
#: What a lookup of one flip costs, in comparisons of two keys.
FLIP_COST = 6
#: Blocks hold a BLOCKS-th of all texts, so that a text's copies don't grow with their number, but LEAST_MEET at least and MOST_MEET at most, which bounds a task's memory: over BLOCKS * MOST_MEET
#: texts a copy more for each MOST_MEET of like size.
BLOCKS, LEAST_MEET, MOST_MEET = 12, 4096, 1 << 18
#: Pairs that are held at once.
PIECE = 1 << 20
_MIX = np.random.default_rng(11).integers(1, 1 << 63, (2, WIDE_BITS // BITS - 1), np.uint64)
_XOR, _TIMES = _MIX[0], _MIX[1] * np.uint64(2) + np.uint64(1)


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """Four words of 64 bits: simhash.fingerprint of the shingles, then the same of their hashes mixed three ways."""
    n = len(shingles)
    ones = np.zeros(WIDE_BITS, np.int64)
    for lo in range(0, n, 255):  # sums that a byte holds
        h = shingles[lo : lo + 255, None]
        x = (h ^ _XOR) * _TIMES
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(np.hstack([h, x]).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > n, bitorder="little").view("<u8")


def keys_of(fp: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of a group, moved together."""
    key = np.zeros(len(fp), np.uint64)
    for i, b in enumerate(group):
        key |= (fp >> np.uint64(b) & np.uint64(1)) << np.uint64(i)
    return key.astype(np.uint16 if len(group) <= 16 else np.uint32 if len(group) <= 32 else np.uint64)


def probed(a: np.ndarray, b: np.ndarray, width: int, t: int, flips: np.ndarray):
    """All places (i, j) with a[i] and b[j], keys of width bits, at most t bits apart, in pieces. Flips of a's keys are looked up among b's; where b has fewer keys than there are flips to look
    up, its keys are run over instead."""
    if len(b) <= FLIP_COST * len(flips):
        for lo in range(0, len(a), step := max(1, (1 << 18) // max(1, len(b)))):
            i, j = np.divmod(np.flatnonzero(np.bitwise_count(a[lo : lo + step, None] ^ b) <= t), len(b))
            yield i + lo, j
        return
    order = np.argsort(b, kind="stable")
    kinds, first, many = np.unique(b[order], return_index=True, return_counts=True)
    direct = None
    if width <= 22:  # each key's place among the kinds, or none
        direct = np.full(1 << width, -1, np.int32)
        direct[kinds] = np.arange(len(kinds))
    for flip in flips:
        x = a ^ flip.astype(a.dtype)
        at = direct[x] if direct is not None else np.minimum(np.searchsorted(kinds, x), len(kinds) - 1)
        i = np.flatnonzero(at >= 0 if direct is not None else kinds[at] == x)
        if not len(i):
            continue
        n = many[at[i]]
        pieces = (np.cumsum(n) - n) // PIECE  # of PIECE pairs, and one key's at most
        cuts = [*np.flatnonzero(np.r_[True, pieces[1:] != pieces[:-1]]).tolist(), len(i)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            some, m = i[lo:hi], n[lo:hi]
            yield np.repeat(some, m), order[np.arange(int(m.sum())) + np.repeat(first[at[some]] - (np.cumsum(m) - m), m)]


def candidates(a: np.ndarray, b: np.ndarray, wide: np.ndarray, size: np.ndarray, parts: list[tuple[list[int], int, np.ndarray]], *, distance: int, similarity: float):
    """Pairs (x of a, y of b), rows of wide (fingerprints) and size, that some partition of parts (bits, threshold, flips) brings together and that may be similar. A pair may come more than once."""
    fp = wide[:, 0]
    for group, t, flips in parts:
        for i, j in probed(keys_of(fp[a], group), keys_of(fp[b], group), len(group), t, flips):
            x, y = a[i], b[j]
            near = np.bitwise_count(fp[x] ^ fp[y]) <= distance
            x, y = x[near], y[near]
            near = (np.bitwise_count(wide[x] ^ wide[y]).sum(1) <= WIDE_DISTANCE) & (np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]) - 1e-9) & (x != y)
            if near.any():
                yield x[near], y[near]


def similar_forest(bucket: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links within each run of equal bucket numbers."""
    child, to = [], []
    bounds = [*np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist(), len(bucket)]
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        by_size = sorted(range(lo, hi), key=lambda i: len(sets[i]))
        tree = {i: i for i in by_size}

        def top(i, tree=tree):
            while tree[i] != i:
                tree[i] = i = tree[tree[i]]
            return i

        for x, i in enumerate(by_size):
            a = sets[i]
            for j in by_size[x + 1 :]:
                b = sets[j]
                if len(a) < similarity * len(b) - 1e-9:  # and so for all larger ones
                    break
                if top(i) == top(j):
                    continue
                same = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                if same / (len(a) + len(b) - same) >= similarity:
                    tree[top(j)] = top(i)
                    child.append(j)
                    to.append(i)
    return child, to


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _row_key(id_: Column, k: Column) -> Column:
    """Id and text hash in one text, never null: a join on a struct deals rows by its fields, and a grouping by the struct deals them again."""
    return F.concat(k.cast("string"), group_key(id_.cast("string"))).alias("_key")


def _of_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose _key is among the keys. Both are dealt by it once, whatever their sizes, and what groups by _key next finds its rows together: as a broadcast the keys would grow with the
    input, and rows that were dealt before Spark turns to one are dealt again for the grouping."""
    return rows.join(keys.hint("merge"), "_key", "left_semi")


def sketches(docs: DataFrame, *, id_col: str, text_col: str, width: int) -> DataFrame:
    """One row for each row of docs: id, k (hash of its text), f (digest of the shingle set), size (of the set), fp (64 bits, signed), wide (fingerprint of WIDE_BITS)."""
    rows = docs.select(F.col(id_col).alias("id"), _text_key(F.col(text_col)).alias("k"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        import pyarrow as pa
        import xxhash

        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                sets = [np.unique(shingle_hashes(t, width)) for t in part.column("text").to_pylist()]
                prints = [xxhash.xxh3_128_digest(s.astype("<u8").tobytes()) for s in sets]
                wide = [wide_fingerprint(s) for s in sets]
                fp = pa.array(np.array([w[0] for w in wide], np.uint64).view(np.int64))
                columns = [part.column("id"), part.column("k"), pa.array(prints, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), fp, pa.array([w.tobytes() for w in wide], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "k", "f", "size", "fp", "wide"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, k long, f binary, size long, fp long, wide binary")


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """k, shingles for each row of texts(k, text): the sorted set of its shingles' hashes, 8 bytes each."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                sets = [np.unique(shingle_hashes(t, width)).astype("<u8").tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(sets, pa.binary())], ["k", "shingles"])

    return texts.mapInArrow(run, "k long, shingles binary")


def meet_of(n: int) -> int:
    """How many of n texts a block holds."""
    return min(MOST_MEET, max(LEAST_MEET, n // BLOCKS))


def dealt(vertices: DataFrame, meet: int, similarity: float) -> DataFrame:
    """k, size, wide, larger, part, key, mine, pair: vertices(k, wide, size) by class of size (key) and pair of blocks, of `meet` rows or somewhat fewer, such that any two texts whose sizes allow the
    similarity meet in one (key, pair). larger: 1 if the text stands there with the class below its own."""
    # sizes of linked sets are in one class or in two that follow each other: a text meets those of its class and of the next
    wide_class = F.floor(F.log(F.col("size").cast("double")) / -math.log(similarity * (1 - 1e-6))).cast("long")
    rows = vertices.select("k", "size", "wide", wide_class.alias("class"))
    each = F.explode(F.array(F.lit(0), F.lit(1))).alias("larger")
    rows = rows.select("k", "size", "wide", "class", each).select("k", "size", "wide", "larger", F.lit(0).alias("part"), (F.col("class") - F.col("larger")).alias("key"))
    counted = kept(rows.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("larger") == 0).alias("own")).where("n > 1 AND own > 0"), "sizes")
    blocks = counted.select("key", F.when(F.col("n") > meet, F.ceil(F.col("n") / meet).cast("int")).alias("blocks"))
    rows = rows.join(blocks, "key").withColumn("mine", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("k"), F.col("blocks"))).cast("int"))
    return rows.select("k", "size", "wide", "larger", "part", "key", "mine", "blocks", F.explode(block_pairs(F.xxhash64("k"))).alias("pair")).drop("blocks")


def candidate_links(vertices: DataFrame, *, similarity: float, distance: int, meet: int | None) -> DataFrame:
    """u, v: edges between the k of vertices(k, fp, wide, size) such that all candidates are connected by them. Blocks hold `meet` texts or somewhat fewer; without it, as many as keep copies of a row few."""
    vertices = vertices.where("size > 0")
    n = vertices.count()
    if n < 2:
        return vertices.select(F.col("k").alias("u"), F.col("k").alias("v")).limit(0)
    groups, _, thresholds = partitions(vertices, n, distance, row_cost=1)
    parts = [(g, t, np.array(_flips(list(range(len(g))), t), np.int64).view(np.uint64)) for g, t in zip(groups, thresholds, strict=True) if t >= 0]
    rows = dealt(vertices, meet or meet_of(n), similarity)
    n_parts = int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n_parts, "part", "key", "pair").sortWithinPartitions("part", "key", "pair")

    def run(batches):
        import pyarrow as pa

        for held, bucket in whole_buckets(batches):
            k, size, larger, mine = (held.column(c).to_numpy() for c in ("k", "size", "larger", "mine"))
            wide = np.frombuffer(b"".join(held.column("wide").to_pylist()), "<u8").reshape(-1, WIDE_BITS // BITS)
            root, some = np.arange(len(k)), False
            bounds = [*np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist(), len(bucket)]
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                first, large = mine[lo:hi] == mine[lo:hi].min(), larger[lo:hi] == 1
                here = [lo + np.flatnonzero(first & ~large), lo + np.flatnonzero(first & large), lo + np.flatnonzero(~first & ~large), lo + np.flatnonzero(~first & large)]
                # of one block: its own class, and that with the next; of two: what stands in different ones
                meetings = [(here[0], here[0]), (here[0], here[1])] if first.all() else [(here[0], here[2]), (here[0], here[3]), (here[2], here[1])]
                for a, b in meetings:
                    if len(a) and len(b):
                        for x, y in candidates(a, b, wide, size, parts, distance=distance, similarity=similarity):
                            root, some = _unite(root, x, y), True
            child = np.flatnonzero(root != np.arange(len(k))) if some else []
            if len(child):
                yield pa.RecordBatch.from_arrays([pa.array(k[child]), pa.array(k[root[child]])], ["u", "v"])

    return rows.mapInArrow(run, "u long, v long").distinct()


def links(vertices: DataFrame, texts: DataFrame, *, width: int, similarity: float, block: int, distance: int = DISTANCE, meet: int | None = None) -> DataFrame:
    """u, v: edges between vertices(v, fp, wide, size) such that linked ones are connected; texts(_key, k, text) has the text of each v's id and k. Sets are made again for those alone
    that have a candidate."""
    stars = components(candidate_links(vertices.select("v.k", "fp", "wide", "size"), similarity=similarity, distance=distance, meet=meet))
    rows = kept(stars.select(F.col("u").alias("k"), F.col("v").alias("key")).unionAll(stars.select(F.col("v").alias("k"), F.col("v").alias("key")).distinct()), "members")
    rows = rows.withColumn("part", F.lit(0)).join(rows.groupBy("key").agg(F.count("*").alias("n")), "key")
    used = vertices.select(F.col("v.k").alias("k"), _row_key(F.col("v.id"), F.col("v.k"))).join(rows.select("k"), "k").select("_key")
    sets = shingle_sets(_of_keys(texts, used).dropDuplicates(["_key"]).select("k", "text"), width)
    rows = rows.withColumn("blocks", F.when(F.col("n") > block, F.ceil(F.col("n") / block).cast("int")))
    rows = rows.select("k", "part", "key", F.explode(block_pairs(F.xxhash64("k"))).alias("pair")).join(sets, "k")
    n_parts = int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n_parts, "part", "key", "pair").sortWithinPartitions("part", "key", "pair")

    def run(batches):
        import pyarrow as pa

        for held, bucket in whole_buckets(batches):
            sets = [np.frombuffer(x.as_buffer(), "<u8") for x in held.column("shingles").chunk(0)]
            child, to = similar_forest(bucket, sets, similarity)
            k = held.column("k").chunk(0)
            if child:
                yield pa.RecordBatch.from_arrays([k.take(pa.array(child)), k.take(pa.array(to))], ["a", "b"])

    edges = rows.mapInArrow(run, "a long, b long").distinct()
    edges = edges.join(vertices.select(F.col("v.k").alias("a"), F.col("v").alias("u")), "a")
    return edges.join(vertices.select(F.col("v.k").alias("b"), "v"), "b").select("u", "v")


def _stars(docs: DataFrame, *, id_col: str, text_col: str, width: int = 5, similarity: float = 0.8, block: int = 512, distance: int = DISTANCE, meet: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sketches; a vertex (v, f) for each shingle set, v its least row's none (no id), id and k; and components' edges from each vertex to its root."""
    prints = kept(sketches(docs, id_col=id_col, text_col=text_col, width=width), "sketches")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k")).alias("m")
    vertices = prints.groupBy("f").agg(least, *[F.first(c).alias(c) for c in ("size", "fp", "wide")]).select("f", "size", "fp", "wide", F.col("m").alias("v"))
    vertices = kept(vertices, "vertices")
    k = _text_key(F.col(text_col))
    texts = docs.select(_row_key(F.col(id_col), k), k.alias("k"), F.col(text_col).cast("string").alias("text"))
    return prints, vertices, components(links(vertices, texts, width=width, similarity=similarity, block=block, distance=distance, meet=meet))


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each row of docs: id_col, component_id (least id that links lead to, itself included; null only if all its ids are). Texts without a word link
    to each other alone. An empty table gives no rows."""
    prints, vertices, stars = _stars(docs, id_col=id_col, text_col=text_col, **options)
    ids = vertices.join(stars.select(F.col("u").alias("v"), F.col("v").alias("root")), "v", "left").select("f", F.coalesce("root", "v")["id"].alias("component_id"))
    return prints.select("id", "f").join(ids, "f").select(F.col("id").alias(id_col), "component_id")


def representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each component: one of its least id (null counts as greatest), of those that of the least text hash. Rows of one id but of different
    texts are documents of their own. The columns may have any other names."""
    _, vertices, stars = _stars(docs, id_col=id_col, text_col=text_col, **options)
    roots = vertices.select("v").join(stars.select(F.col("u").alias("v")), "v", "left_anti").select(_row_key(F.col("v.id"), F.col("v.k")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = _of_keys(docs.select(_row_key(F.col(id_col), _text_key(F.col(text_col))), row), roots)
    one = F.row_number().over(Window.partitionBy("_key").orderBy(F.xxhash64("row")))
    return rows.withColumn("_n", one).where("_n = 1").select("row.*")
