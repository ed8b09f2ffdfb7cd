"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint holds, for each of 64 bits, whether more than half of its shingles' hashes set it. Two fingerprints
link at `distance` or fewer differing bits. Bits are grouped into partitions, correlated ones together, and each partition i gets a threshold t_i of
its own with sum(t_i + 1) = distance + 1, so a linked pair differs by at most t_i bits in some partition i; thresholds from -1 (not probed) up
are allocated by dynamic programming on estimated candidate counts. Fingerprints meet in the buckets of their partition's bits,
and of those within t_i flips, and are verified there by their full distance.

Equal fingerprints are one vertex from the start. A bucket yields a spanning forest of its links, never all pairs; a large one is dealt into
blocks, and every two blocks meet in a task of their own, so no link is lost and no task holds more than two blocks. Components
are found by alternating large-star and small-star steps over the forest edges, all of it distributed.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import kept

BITS = 64
SEED = 42
#: Moving a row to its bucket costs about as much as this many comparisons inside one: about a microsecond of shuffle and sort against some 5 ns.
ROW_COST = 200


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """64-bit hashes of each run of width words (all words if fewer), lower-cased A-Z and split at white space; none without a word."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = map(b" ".join, zip(*[words[i:] for i in range(width)], strict=False)) if len(words) >= width else [b" ".join(words)]
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in runs), np.uint64, max(1, len(words) - width + 1))


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 bits; lower-cases A-Z, splits at white space, hashes each run of width words (all words if fewer). 0 without a word."""
    hashes = shingle_hashes(text, width)
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, n, 1 << 16):  # a long text's bits in pieces
        ones += np.unpackbits(hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """id_col and fp (the fingerprint as a signed long), one row for each row of docs."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp.view(np.int64))], ["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long").withColumnRenamed("id", id_col)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _correlations(fps: DataFrame) -> np.ndarray:
    """|correlation| of each two bits over all fps. 64 x 64 counts a task are added up; only the sums reach the driver."""

    def run(batches):
        import pyarrow as pa

        both = np.zeros((BITS, BITS))
        for b in batches:
            bits = np.unpackbits(np.ascontiguousarray(b.column("fp").to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(both.ravel().astype(np.int64))], ["cell", "n"])

    sums = np.zeros(BITS * BITS)
    for r in fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        sums[r.cell] = r.n
    both, n = sums.reshape(BITS, BITS), max(1, fps.count())
    p = np.diag(both) / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    return np.abs((both / n - np.outer(p, p)) / np.outer(sd, sd))


def bit_groups(correlation: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal width: each begins with the free bit most correlated with all free ones and takes the bit most correlated with the group."""
    free, groups = set(range(BITS)), []
    for g in range(m):
        width = math.ceil(len(free) / (m - g))
        of = sorted(free)
        group = [of[int(np.argmax(correlation[np.ix_(of, of)].sum(1)))]]
        free.discard(group[0])
        while len(group) < width:
            of = sorted(free)
            best = of[int(np.argmax(correlation[np.ix_(of, group)].mean(1)))]
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def candidate_estimates(n: int, collisions: list[float], widths: list[int], distance: int, row_cost: float = ROW_COST) -> list[list[float]]:
    """For each partition, the cost of thresholds 0 to distance: candidates to compare, and rows to move. collisions: sum of squared bucket sizes, counted over all fingerprints.
    What is above chance is taken to be clusters, an eighth of whose members are found again for each further bit that is flipped."""
    out = []
    for c, w in zip(collisions, widths, strict=True):
        chance = n * n / 2.0**w
        by_flips = [math.comb(w, j) * (chance + max(0.0, c - chance) / 8.0**j + row_cost * n) for j in range(distance + 1)]
        out.append(np.cumsum(by_flips).tolist())
    return out


def allocate(estimates: list[list[float]], distance: int) -> list[int]:
    """Thresholds of least total cost with sum(t_i + 1) = distance + 1, each from -1 up: dynamic programming over partitions and what is left to give."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for costs in estimates:
        step: dict[int, tuple[float, list[int]]] = {}
        for given, (cost, ts) in best.items():
            for t in range(-1, distance + 1 - given):
                to = given + t + 1
                new = (cost + (costs[t] if t >= 0 else 0.0), [*ts, t])
                if to not in step or new < step[to]:
                    step[to] = new
        best = step
    return best[distance + 1][1]


def partitions(vertices: DataFrame, n: int, distance: int, numbers: tuple[int, ...] = (4, 3, 2), row_cost: float = ROW_COST) -> tuple[list[list[int]], list[int], list[int]]:
    """Groups of bits, their masks and thresholds: of each number of partitions the best allocation, and of these the cheapest, by collisions counted over all n vertices. row_cost: what
    a flip of a row costs, in comparisons."""
    correlation = _correlations(vertices)
    choices = [bit_groups(correlation, m) for m in numbers]
    every = [g for groups in choices for g in groups]
    masks = [_signed(sum(1 << b for b in g)) for g in every]
    exact = vertices.select(F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(x)) for x in masks])).alias("part", "key"))
    got = {r.part: r.c for r in exact.groupBy("part", "key").count().groupBy("part").agg(F.sum(F.col("count").cast("double") ** 2).alias("c")).collect()}
    best, at = None, 0
    for groups in choices:
        costs = candidate_estimates(n, [got.get(at + i, 0.0) for i in range(len(groups))], [len(g) for g in groups], distance, row_cost)
        thresholds = allocate(costs, distance)
        cost = sum(c[t] for c, t in zip(costs, thresholds, strict=True) if t >= 0)
        if best is None or cost < best[0]:
            best = cost, groups, masks[at : at + len(groups)], thresholds
        at += len(groups)
    return best[1:]


def _flips(group: list[int], t: int) -> list[int]:
    """XOR masks of at most t of the group's bits."""
    from itertools import combinations

    return [_signed(sum(1 << b for b in bits)) for j in range(t + 1) for bits in combinations(group, j)]


def _at(part: int, own: Column, flips: Column) -> Column:
    return F.transform(flips, lambda x: F.struct(F.lit(part).alias("part"), own.bitwiseXOR(x).alias("key")))


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the trees of a[j] and b[j]; root points at each element's root, the least of its tree."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def bucket_forest(bucket: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (child, root) of a spanning forest of the links within each run of equal bucket numbers."""
    n = len(fp)
    root = np.arange(n)
    change = np.flatnonzero(np.r_[bucket[1:] != bucket[:-1], True])
    end = change[np.searchsorted(change, np.arange(n))] + 1
    at, waiting, size = np.arange(n), [], 0
    for off in range(1, n):
        at = at[at + off < end[at]]
        if not len(at):
            break
        near = at[np.bitwise_count(fp[at] ^ fp[at + off]) <= distance]
        near = near[root[near] != root[near + off]]
        if len(near):
            waiting.append((near, near + off))
            size += len(near)
        if size > 200_000:
            root, waiting, size = _unite(root, *map(np.concatenate, zip(*waiting, strict=True))), [], 0
    if waiting:
        root = _unite(root, *map(np.concatenate, zip(*waiting, strict=True)))
    child = np.flatnonzero(root != np.arange(n))
    return child, root[child]


def block_pairs(own: Column) -> Column:
    """The pairs of blocks that a row of hash own is in, of a bucket dealt into column blocks; one pair if that is null."""
    mine = F.pmod(own, F.col("blocks")).cast("int")
    return F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.least(x, mine) * F.col("blocks") + F.greatest(x, mine)))


def links(vertices: DataFrame, *, distance: int = 3, block: int = 2048) -> DataFrame:
    """u, v: edges between vertices(fp, v) whose fingerprints link, such that all linked vertices are connected by them. One vertex for each fp."""
    n = vertices.count()
    groups, masks, thresholds = partitions(vertices, n, distance)
    places = []
    for i, t in enumerate(thresholds):
        if t >= 0:
            flips = F.array(*[F.lit(x) for x in _flips(groups[i], t)])
            own = F.col("fp").bitwiseAND(F.lit(masks[i]))
            places.append(_at(i, own, flips))
    rows = vertices.select("v", "fp", F.explode(F.concat(*places)).alias("p")).select("v", "fp", "p.part", "p.key")
    large = rows.groupBy("part", "key").count().where(F.col("count") > block).select("part", "key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    rows = rows.join(large, ["part", "key"], "left")
    rows = rows.select("v", "fp", "part", "key", F.explode(block_pairs(F.xxhash64("fp"))).alias("pair"))
    n_parts = int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n_parts, "part", "key", "pair").sortWithinPartitions("part", "key", "pair")

    def run(batches):
        import pyarrow as pa

        for held, bucket in whole_buckets(batches):
            child, root = bucket_forest(bucket, held.column("fp").to_numpy().view(np.uint64), distance)
            v = held.column("v").chunk(0)
            if len(child):
                yield pa.RecordBatch.from_arrays([v.take(pa.array(child)), v.take(pa.array(root))], ["u", "v"])

    kind = vertices.schema["v"].dataType.simpleString()
    return rows.mapInArrow(run, f"u {kind}, v {kind}").distinct()


def whole_buckets(batches):
    """Tables of whole buckets, and each row's bucket number: rows sorted by part, key and pair, cut where these change."""
    import pyarrow as pa

    held = None
    for b in _and_end(batches):
        if b is not None:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < 4096:
                continue
        if held is None or not held.num_rows:
            continue
        held = held.combine_chunks()
        cols = [held.column(c).to_numpy() for c in ("part", "key", "pair")]
        new = np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in cols])]
        upto = held.num_rows if b is None else int(np.flatnonzero(new)[-1])  # the last bucket may go on in the next batch
        if not upto:
            continue
        yield held.slice(0, upto).combine_chunks(), np.cumsum(new)[:upto]
        held = held.slice(upto)


def _and_end(batches):
    yield from batches
    yield None


def components(edges: DataFrame) -> DataFrame:
    """u, v: each vertex of edges(u, v) that isn't its component's least, and that least vertex.

    Alternating star steps: a large-star step joins every vertex's larger neighbours to its least neighbour, a small-star step its smaller ones and itself. Each
    step's minima and edges are kept as tables, so that a hub's rows are a plain skewed join, which is split, and lost executors cost one step at most.
    """
    e = kept(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = kept(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        # larger neighbours only: those of e as it is, seen from their smaller end
        large = e.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = kept(large, "large")
        least = kept(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m")), F.struct(F.col("u").alias("a"), F.col("m")))).alias("x"))
        e = kept(small.select(F.col("x.a").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct(), "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            return e
        before = now


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3, block: int = 2048) -> DataFrame:
    """One row for each row of docs: id_col, fingerprint (16 hex digits), component_id (least id that links lead to, itself included).

    Null and empty texts have fingerprint 0 and link like others. Repeated rows share a component. Null ids count as greater than all others, so a component_id is
    null only if all its ids are. An empty table gives no rows.
    """
    prints = kept(fingerprints(docs, id_col=id_col, text_col=text_col, width=width).withColumnRenamed(id_col, "id"), "prints")
    none = F.col("d").isNull()
    vertices = kept(prints.groupBy("fp").agg(F.min("id").alias("d")).select("fp", F.struct(none.alias("none"), F.col("d"), F.col("fp").alias("f")).alias("v")), "vertices")
    stars = components(links(vertices, distance=distance, block=block))
    ids = kept(vertices.join(stars.select(F.col("u").alias("v"), F.col("v").alias("root")), "v", "left").select("fp", F.coalesce("root.d", "v.d").alias("component_id")), "ids")
    return prints.join(ids, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
