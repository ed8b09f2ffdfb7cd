"""The training-data operators against brute force, round trips, and odd inputs."""

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import binary, decontamination, lmscore, outliers, simhash
from millrace.llm.mixing import mixed_documents, mixture
from millrace.llm.pretokens import Encoder, load
from millrace.llm.sharding import interleaved_shards
from millrace.llm.tokens import token_counts
from millrace.llm.toxicity import score, train
from millrace.llm.urls import temporal_url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_tokens string"
LONG = "word " * 60_000
ODD = [(1, None, None, None, "x"), (2, "", "en", "a", "x"), (3, LONG, "en", "a", "x"), (4, "Same text here", "en", None, "x"), (4, "Same text here", "en", None, "x"), (None, "No id <|endoftext|> at all", "fr", "b", None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    return load("byte_bpe_50k.json")


def test_token_counts(spark, odd, tokenizer):
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(odd).collect())
    n = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    assert got == Counter((r[0], len((r[1] or "").encode()), n(r[1]), n(r[1]) > 512) for r in ODD)
    assert token_counts(odd.limit(0)).count() == 0


_encoder = Encoder("byte_bpe_50k.json", most=50)
_whole = load("byte_bpe_50k.json")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", " \n", "a", "bc", "'s", "é", "1", "!?", "\x1c", "\x85", "\t", "<|endoftext|>", "字", "Z.", "͸"]), max_size=14).map("".join))
def test_pretokens_equal_the_library(text):
    ids = _whole.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(_encoder.ids(text), "<u2").tolist() == ids and _encoder.count(text) == len(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10**6), max_size=700).map(sorted))
def test_elias_fano(values):
    e, end = binary.EliasFano.from_bytes(data := binary.EliasFano.encode(np.array(values, np.uint64)).to_bytes())
    assert end == len(data) and e.decode().tolist() == values and [e.select(i) for i in range(len(values))] == values


def test_token_files(spark, odd, tokenizer):
    got = binary.token_files(odd, segment_tokens=100).orderBy("start").collect()
    want, start = [], 0
    for doc_id, text, *_ in sorted(ODD, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want
    assert binary.token_files(odd.limit(0)).count() == 0


def test_shards(spark, odd):
    docs = spark.range(1003).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"))
    rows = interleaved_shards(docs).collect()
    by = Counter(r.shard for r in rows)
    assert max(by.values()) - min(by.values()) <= 1 and {(r.shard, r.slot) for r in rows} == {(s, i) for s in by for i in range(by[s])}
    mix = Counter((r.shard, "null" if r.doc_id % 3 == 0 else r.doc_id % 5) for r in rows)
    for source in ["null", 0, 1, 2, 3, 4]:
        assert max(mix[s, source] for s in by) - min(mix[s, source] for s in by) <= 2
    assert interleaved_shards(odd).count() == len(ODD) and interleaved_shards(odd.limit(0)).count() == 0


def test_mixture(spark, odd):
    rows = mixture(odd).collect()
    docs = [(i, "w " * (1 + i % 37), "ab"[i % 2] if i % 5 else None) for i in range(3000)]
    many = mixture(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    sources = {}
    for r in many:
        size, target, taken, spread = sources.get(r.source_size, (0, 0, 0, 0.0))
        f = r.target / r.source_size % 1
        sources[r.source_size] = (size + r.size, r.target, taken + r.taken, spread + r.size**2 * f * (1 - f))
    assert len(sources) == 3 and sum(t for _, t, _, _ in sources.values()) == pytest.approx(1.5 * sum(r.size for r in many))
    assert all(abs(taken - target) <= 4 * spread**0.5 + 1e-6 for _, target, taken, spread in sources.values())
    assert all(r.taken <= 2 * r.size and r.target <= 2 * r.source_size + 1e-6 for r in rows)
    assert mixed_documents(odd).columns == odd.columns and mixed_documents(odd).count() == sum(r.copies for r in rows)
    assert mixture(odd.limit(0)).count() == 0


def test_near_duplicates_equal_brute_force(spark, odd):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(300):
        base = [words[j] for j in rng.integers(0, 400, 120)] if i % 3 == 0 else docs[-1][1].split()
        if i % 3:
            base[int(rng.integers(0, len(base)))] = "changed"
        docs.append((i, " ".join(base)))
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), block=8).collect()}
    fp = [simhash.fingerprint(t) for _, t in docs]
    root = list(range(300))
    for _ in range(300):
        new = [min(root[j] for j in range(300) if bin(fp[i] ^ fp[j]).count("1") <= 3) for i in range(300)]
        if new == root:
            break
        root = new
    assert got == {i: (fp[i], root[i]) for i in range(300)}
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == len(ODD) and {r.component_id for r in found if r.doc_id in (1, 2)} == {1}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_thresholds_cover_the_distance():
    for m, widths in ((4, [16] * 4), (3, [22, 21, 21]), (2, [32, 32])):
        t = simhash.allocate(simhash.candidate_estimates(10**6, [1e9, 10, 10, 10][:m], widths, 3), 3)
        assert sum(x + 1 for x in t) == 4


def test_unequal_thresholds_win_where_a_partition_is_crowded():
    crowded = simhash.candidate_estimates(10**6, [1e12, 1e8, 1e8, 2e8], [16] * 4, 3)
    t = simhash.allocate(crowded, 3)
    assert t[0] == -1 and sorted(t) == [-1, 0, 0, 1]
    from itertools import product

    cost = lambda ts: sum(c[x] for c, x in zip(crowded, ts, strict=True) if x >= 0)
    assert cost(t) == min(cost(ts) for ts in product(range(-1, 4), repeat=4) if sum(x + 1 for x in ts) == 4)


def test_crowded_bits_are_linked_all_the_same(spark):
    rng = np.random.default_rng(4)
    fps = []
    for i in range(400):  # the low 16 bits are the same in all
        fp = (int(rng.integers(0, 1 << 24)) << 24) if i % 2 == 0 else fps[-1] ^ (1 << int(rng.integers(16, 64))) ^ (1 << int(rng.integers(16, 64)))
        fps.append(fp)
    fps = sorted(set(fps))
    signed = [(simhash._signed(x), x) for x in fps]
    edges = simhash.links(spark.createDataFrame([(s, i) for i, (s, _) in enumerate(signed)], "fp long, v long"), block=16)
    stars = {r.u: r.v for r in simhash.components(edges).collect()}
    root = list(range(len(fps)))
    while (new := [min(root[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(fps))]) != root:
        root = new
    assert [stars.get(i, i) for i in range(len(fps))] == root


def test_decontamination(spark, odd):
    item = "the quick brown fox jumps over the lazy dog tonight. what does the animal leap over again"
    bench = spark.createDataFrame([(7, item), (8, "another item that nobody has ever copied anywhere at all"), (9, None), (10, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{'pad ' * 200} {item.upper()} {'pad ' * 90}"), (2, item[:40]), (3, None), (4, "pad " * 500)], "doc_id long, text string")
    got = decontamination.contaminated(docs, bench).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 7)] and got[0].score == pytest.approx(1.0)
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench, block_mb=1e-4).collect()} == {(1, 7)}
    assert sorted(r.doc_id for r in decontamination.decontaminated(docs, bench).collect()) == [2, 3, 4]
    assert decontamination.contaminated(odd, bench).count() == 0 and decontamination.decontaminated(odd, bench.limit(0)).count() == len(ODD)


def test_toxicity_on_held_out_rows(spark, odd):
    rng = np.random.default_rng(5)
    docs = []
    for i in range(600):
        text = [f"w{j}" for j in rng.integers(0, 200, 60)]
        bad = i % 4 == 0
        text[5:5] = ["idiot", "you", "moron!"] if bad else (["idiot"] if i % 4 == 1 else ["moron"] if i % 4 == 2 else [])
        docs.append((i, " ".join(text), int(bad)))
    table = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    model = train(table.select("doc_id", "text"), table.select("doc_id", "toxic"), usable=F.col("id") < 400)
    got = {r.doc_id: r.predicted for r in score(table, model).collect()}
    assert np.mean([got[i] == t for i, _, t in docs if i >= 400]) > 0.9
    assert all(0 <= r.score <= 1 for r in score(odd, model).collect()) and score(odd, model).count() == len(ODD)
    empty = train(table.limit(0).select("doc_id", "text"), table.limit(0).select("doc_id", "toxic"))
    assert score(odd, empty).count() == len(ODD)


def test_language_scores(spark, odd):
    docs = [(i, " ".join(["alpha beta", "gamma Delta", "rare%d" % i][j % 3] for j in range(i % 7))) for i in range(60)]
    rows = lmscore.language_scores(spark.createDataFrame(docs, "doc_id long, text string"), learns=F.col("doc_id") % 5 > 0).collect()
    train_words = Counter(w for i, t in docs if i % 5 for w in [*t.lower().split(), None])
    n, v = sum(train_words.values()), len(train_words)
    for r in rows:
        t = [*docs[r.doc_id][1].lower().split(), None]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(train_words[w] > 0 for w in t), n, r.doc_id % 5 == 0)
        assert r.base_score == pytest.approx(sum(np.log10((train_words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) and r.score < 0
    assert lmscore.language_scores(odd).count() == len(ODD) and lmscore.language_scores(odd.limit(0)).count() == 0


def test_huffman_is_a_prefix_code():
    code = lmscore.code_of(lmscore.code_lengths(np.array([5, 1, 1, 9, 3])))
    paths = [tuple(code.path[a:b]) for a, b in zip(code.first[:-1], code.first[1:], strict=True)]
    assert sum(2.0 ** -len(p) for p in paths) == 1 and len(set(paths)) == 5


def test_outliers(spark, odd):
    rng = np.random.default_rng(9)
    docs = [(i, " ".join("x" * int(k) for k in rng.integers(2, 9, 80 + i % 40)) if i % 50 else " ".join(["###", "|", "<%&>"] * 25 + [f"y{j}" for j in range(9)]), "en", "a", "") for i in range(400)]
    got = {r.doc_id: r for r in outliers.outliers(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert [got[i].kept for i in range(400) if i % 50].count(False) <= 3 and not any(got[i].kept for i in range(0, 400, 50))
    rows = outliers.outliers(odd).collect()
    assert len(rows) == len(ODD) and outliers.outliers(odd.limit(0)).count() == 0
    words = ["a", "b", "c", "d", "e", "f", "a", "b", "c", "d", "e", "z", "a", "b", "c", "d", "e", "f"]
    one = spark.createDataFrame([(1, " ".join(words), "en", "s", "")], SCHEMA)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    assert outliers.outliers(one).first().n_repeat_words == len(marked)


def test_chi2():
    assert outliers.chi2_quantile(0.975, 5) == pytest.approx(12.8325, abs=1e-3)


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://A.b.example:80/x/y?q", "2024-01-10"), (2, "http://a.b.example/z", "2024-01-10"), (3, "http://a.b.example/x", "2024-03-01"), (4, None, "2024-01-10"), (5, "http://c.example", None)], "page_id long, url string, fetched_at string")
    entries = spark.createDataFrame([("b.example", "add", "2024-01-01"), ("b.example", "remove", "2024-02-01"), ("a.b.example/x", "add", "2024-01-05"), ("a.b.example/x", "remove", "2024-03-01"), ("c.example", "add", "2020-01-01"), (None, "add", "2020-01-01")], "entry string, action string, effective_at string")
    got = {r.page_id: (r.blocked, r.matched_entry) for r in temporal_url_filter(pages, entries).collect()}
    assert got == {1: (True, "a.b.example/x"), 2: (True, "b.example"), 3: (False, None), 4: (False, None), 5: (False, None)}
    assert temporal_url_filter(pages.limit(0), entries).count() == 0 and temporal_url_filter(pages, entries.limit(0)).where("blocked").count() == 0


def test_workers_get_few_large_rows_at_once(spark):
    import pyarrow as pa

    from millrace.llm import lmscore
    from millrace.llm.common import BATCH_ROWS, kept

    def sizes(batches):
        yield from (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches)

    before = spark.conf.get(BATCH_ROWS)
    rows = spark.range(0, 1000, 1, 2).mapInArrow(sizes, "n long")
    got = [r.n for r in kept(rows, "sizes", batch_rows=lmscore.LARGE_ROWS).collect()]
    assert sum(got) == 1000 and max(got) <= lmscore.LARGE_ROWS and spark.conf.get(BATCH_ROWS) == before
    assert max(r.n for r in kept(rows, "sizes").collect()) == 500
