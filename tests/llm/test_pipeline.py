"""The corpus pipeline's stages against brute force."""

import numpy as np
import pytest

import corpus_pipeline


def shingle_set(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def groups(texts):
    """Each text's group: the least index that links of similarity 0.8 or more lead to."""
    sets = [shingle_set(t) for t in texts]
    near = [[j for j in range(len(texts)) if similarity(sets[i], sets[j]) >= 0.8] for i in range(len(texts))]
    root = list(range(len(texts)))
    while (new := [min(root[j] for j in near[i]) for i in range(len(texts))]) != root:
        root = new
    return root


@pytest.fixture(scope="module")
def planted():
    """Texts of 200 words in threes: one, a copy with one to five words changed, an exact copy in capitals."""
    rng = np.random.default_rng(7)
    texts = []
    for i in range(80):
        base = [f"w{j}" for j in rng.integers(0, 500, 200)]
        near = list(base)
        for j in rng.choice(200, 1 + i % 5, replace=False):
            near[j] = "changed"
        texts += [" ".join(base), " ".join(near), " ".join(base).upper()]
    return [*texts, None, "", " \n", "two words", "Two  Words", "two other"]


def test_near_dedup_keeps_one_of_each_group_of_similarity_0_8(spark, planted):
    docs = spark.createDataFrame(list(enumerate(planted)), "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == sorted(set(groups(planted)))


def test_a_dealt_bucket_loses_no_link(spark, planted):
    from millrace.llm.nearcopies import near_copies

    base = "the same text but for its last word, as long as it takes to be similar all the same though it ends in a word of its own such as".split()
    texts = [" ".join([*base, f"x{i}"]) for i in range(40)] + planted[:30]
    found = near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=4).collect()
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(groups(texts)))
    assert near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_row_stays_of_each_component_without_ids_too(spark, planted):
    from millrace.llm.nearcopies import representatives

    a, near_a, b, near_b, c, d = planted[0], planted[1], planted[3], planted[4], planted[6], planted[9]
    rows = [(None, a), (None, near_a), (None, a), (1, b), (None, near_b), (5, c), (5, d), (5, d), (9, d)]
    got = representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and {(r.doc_id, r.text) for r in got if r.doc_id is not None} == {(1, b), (5, c), (5, d)}
    assert [r.text in (a, near_a) for r in got if r.doc_id is None] == [True]


def test_candidates_come_from_partitions_of_simhash_probed_within_their_thresholds():
    from millrace.llm import nearcopies as nc
    from millrace.llm.simhash import _flips, fingerprint, shingle_hashes

    rng = np.random.default_rng(3)
    for width, t in ((16, 0), (16, 2), (23, 2), (16, 4)):  # few keys: run over; many: flips are looked up
        for n in (40, 1500):
            a, b = (rng.integers(0, 1 << width, n).astype(np.uint16 if width == 16 else np.uint32) for _ in range(2))
            flips = np.array(_flips(list(range(width)), t), np.int64).view(np.uint64)
            got = [(x, y) for i, j in nc.probed(a, b, width, t, flips) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
            assert len(got) == len(set(got)) and set(got) == set(zip(*map(np.ndarray.tolist, np.nonzero(np.bitwise_count(a[:, None] ^ b) <= t)), strict=True))
    text = " ".join(f"w{i}" for i in rng.integers(0, 99, 700))
    assert int(nc.wide_fingerprint(shingle_hashes(text, 5))[0]) == fingerprint(text, 5)
    # pairs of sets at a similarity of 0.8: within the distances, but for one in thousands
    apart = []
    for _ in range(2000):
        s = rng.integers(1, 1 << 63, 90).astype(np.uint64)
        apart.append(np.bitwise_count(nc.wide_fingerprint(s) ^ nc.wide_fingerprint(np.r_[s[:80], rng.integers(1, 1 << 63, 10).astype(np.uint64)])))
    assert sum(x[0] > nc.DISTANCE for x in apart) <= 2 and max(int(x.sum()) for x in apart) <= nc.WIDE_DISTANCE


def test_texts_dealt_into_blocks_by_size_meet_their_near_copies(spark, planted):
    from pyspark.sql import functions as F

    from millrace.llm import nearcopies as nc

    rng = np.random.default_rng(5)
    grown = [" ".join([*planted[0].split(), *[f"n{j}" for j in rng.integers(0, 999, n)]]) for n in (20, 40, 60, 110)]  # a chain over classes of size
    texts = [*planted, *grown]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = nc.near_copies(docs, meet=16, block=4).collect()
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(groups(texts)))
    # at a distance of 3 only what SimHash's partitions bring together is linked
    prints = {r.id: int.from_bytes(bytes(r.wide)[:8], "little") for r in nc.sketches(docs, id_col="doc_id", text_col="text", width=5).where(F.col("size") > 0).collect()}
    near = {r.doc_id: r.component_id for r in nc.near_copies(docs, distance=3).collect()}
    assert any(near[i] != found_id for i, found_id in enumerate(groups(texts)))
    assert all((prints[i] ^ prints[i + 1]).bit_count() > 3 or near[i + 1] == near[i] for i in range(0, 240, 3))


def test_rows_that_are_dealt_grow_as_the_texts_do_and_lose_no_meeting(spark):
    from pyspark.sql import functions as F

    from millrace.llm import nearcopies as nc

    def made(n):  # all of one size
        return spark.range(n).select(F.col("id").alias("k"), F.lit(100).cast("long").alias("size"), F.lit(b"\0" * 32).alias("wide"), F.xxhash64("id").alias("fp"))

    def moved(n):  # what the plan of the default block size deals
        return nc.dealt(made(n), nc.meet_of(n), 0.8).count()

    assert moved(240_000) <= 2.2 * moved(120_000)
    assert nc.meet_of(1 << 40) == nc.MOST_MEET and nc.meet_of(10) == nc.LEAST_MEET
    sizes = [10, 11, 12, 13, 50, 55, 60, 62]
    few = made(80).withColumn("size", F.element_at(F.array(*[F.lit(x).cast("long") for x in sizes]), (F.col("k") % 8 + 1).cast("int")))
    at = {}
    for r in nc.dealt(few, 6, 0.8).collect():
        at.setdefault((r.key, r.pair), set()).add(r.k)
    for x in range(80):
        for y in range(x):
            a, b = sorted((sizes[x % 8], sizes[y % 8]))
            assert a < 0.8 * b or any({x, y} <= group for group in at.values())


def test_pairs_of_many_equal_keys_come_in_pieces():
    from millrace.llm import nearcopies as nc

    a = np.zeros(3000, np.uint16)
    a[:10] = 1
    pieces = [i * 3000 + j for i, j in nc.probed(a, a, 16, 0, np.zeros(1, np.uint64))]
    assert max(map(len, pieces)) <= nc.PIECE + len(a)
    assert np.array_equal(np.sort(np.concatenate(pieces)), np.flatnonzero((a[:, None] == a).ravel()))


def test_representatives_deal_the_rows_once_whatever_the_size(spark, planted):
    from millrace.llm.nearcopies import representatives

    docs = spark.createDataFrame(list(enumerate(planted)), "doc_id long, text string")
    plan = representatives(docs)._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len(dealt) == 2 and all("hashpartitioning(_key#" in x for x in dealt), plan  # the rows, and the keys that stay
