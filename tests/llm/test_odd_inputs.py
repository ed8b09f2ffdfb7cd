"""Every operator and stage over one table of odd rows, whose extra columns are named as the operators name theirs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import binary
from millrace.llm.decontamination import contaminated, decontaminated
from millrace.llm.lmscore import language_scores
from millrace.llm.mixing import mixed_documents, mixture
from millrace.llm.nearcopies import representatives
from millrace.llm.outliers import outliers
from millrace.llm.sharding import interleaved_shards, read_shards, write_shards
from millrace.llm.simhash import fingerprint, near_duplicates
from millrace.llm.tokens import token_counts
from millrace.llm.toxicity import score, train, without_toxic
from millrace.llm.urls import temporal_url_filter

CLASHES = ["id", "score", "predicted", "c0", "row", "shard", "slot", "a.b", "s", "h", "k", "word", "size", "label", "item", "salt", "key"]
LONG = " ".join(f"w{i % 977}" for i in range(140_000))
OTHER = " ".join(f"v{i % 977}" for i in range(70_000))
ITEM = "which of the old towers by the river still stands in our time. the one beside the northern gate of the town"
ROWS = [(1, None, None, None), (2, "", "en", "a"), (3, LONG, "en", "a"), (4, "Same text here", "en", None), (4, "Same text here", "en", None), (4, "another text of that id", "en", "b"), (None, "no id <|endoftext|> at all", "fr", "b"), (6, f"{OTHER} {ITEM} {OTHER}", "en", "a"), (7, "x" * 70_000, "en", "c"), (8, " \t\n ", "", "")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, *["x"] * len(CLASHES)) for r in ROWS]
    return spark.createDataFrame(rows, ", ".join(["doc_id long, text string, lang string, source string", *[f"`{c}` string" for c in CLASHES]])).cache()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(7, ITEM), (8, None), (9, "")], "item_id int, text string")


@pytest.fixture(scope="module")
def machine(spark, docs):
    return train(docs, docs.select("doc_id", F.lit(1).alias("toxic")))


def ids(df):
    return sorted((r[0] for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))


ALL = sorted((r[0] for r in ROWS), key=lambda x: (x is None, x))


@pytest.mark.parametrize("operator", [token_counts, outliers, interleaved_shards, language_scores, near_duplicates, mixture, binary.token_files])
def test_one_row_for_each(docs, operator):
    assert ids(operator(docs)) == ALL
    assert operator(docs.limit(0)).count() == 0


def test_filters_keep_the_columns_as_they_are(docs, bench, machine):
    for kept in (without_toxic(docs, machine, threshold=2.0), decontaminated(docs, bench), mixed_documents(docs), representatives(docs)):
        assert kept.columns == docs.columns
        assert all(r["a.b"] == "x" and r["score"] == "x" for r in kept.collect())
    assert ids(decontaminated(docs, bench)) == [i for i in ALL if i != 6]
    assert ids(score(docs, machine)) == ALL
    assert ids(without_toxic(docs, machine, threshold=2.0)) == ALL and without_toxic(docs, machine, threshold=0.0).count() == 0


def test_items_with_int_and_text_ids(docs, bench):
    assert [(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()] == [(6, 7)]
    named = bench.withColumn("item_id", F.col("item_id").cast("string"))
    assert [(r.doc_id, r.item_id) for r in contaminated(docs, named).collect()] == [(6, "7")]


def test_shards_hold_the_rows_as_given(spark, docs, tmp_path):
    unique = docs.dropDuplicates(["doc_id"])
    path = str(tmp_path / "shards")
    write_shards(unique, path, shards=2)
    back = read_shards(spark, path, 0).unionAll(read_shards(spark, path, 1))
    assert back.columns == docs.columns and sorted(back.collect(), key=str) == sorted(unique.collect(), key=str)


def test_segments_give_any_document(spark, docs, tmp_path):
    path = str(tmp_path / "tokens")
    binary.write_token_files(docs, path, segment_tokens=1000, partitions=2)
    want = {}
    from millrace.llm.pretokens import load

    library = load("byte_bpe_50k.json")
    for r in ROWS:
        want.setdefault(r[0], []).append([*library.encode(r[1] or "", add_special_tokens=False).ids, 0])
    seen = 0
    for r in spark.read.parquet(path).collect():
        s = binary.Segment(bytes(r.payload))
        for i in np.random.default_rng(1).permutation(s.n_docs).tolist():
            assert s.ids(i).tolist() in want[s.keys[i]]
            seen += 1
    assert seen == len(ROWS)


def test_a_long_text_in_pieces_has_the_whole_ones_fingerprint():
    import xxhash

    words = LONG.split()
    ones = np.zeros(64, int)
    for i in range(len(words) - 2):
        h = xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42)
        ones += [h >> b & 1 for b in range(64)]
    assert fingerprint(LONG) == sum(1 << b for b in range(64) if 2 * ones[b] > len(words) - 2)


def test_captures_that_match_nothing_and_hot_ones(spark):
    pages = [(i, "http://hot.example/x", "2024-01-10") for i in range(50)] + [(100, None, "2024-01-10"), (101, "http://hot.example/x", None), (102, "http://" + "y." * 3000 + "example/", "2024-01-10")]
    entries = spark.createDataFrame([("hot.example", "add", "2024-01-01"), ("hot.example", "add", "2024-01-01")], "entry string, action string, effective_at string")
    got = {r.page_id: r.blocked for r in temporal_url_filter(spark.createDataFrame(pages, "page_id long, url string, fetched_at string"), entries).collect()}
    assert len(got) == len(pages) and sorted(i for i, b in got.items() if not b) == [100, 101, 102]


def test_pipeline_stages_over_odd_rows(spark, docs, bench, tmp_path):
    sf = str(tmp_path)
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{j}" for j in rng.integers(0, 300, 60)) for _ in range(120)]
    texts = [f"you idiot {t} moron" if i % 4 == 0 else t for i, t in enumerate(texts)]
    rows = [(100 + i, t, "en", "a", *["x"] * len(CLASHES)) for i, t in enumerate(texts)] + [(300 + i, t, "en", "b", *["x"] * len(CLASHES)) for i, t in enumerate(texts[:20])]
    whole = docs.unionAll(spark.createDataFrame(rows, docs.schema))
    whole.write.parquet(f"{sf}/documents.parquet")
    bench.write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(100 + i, int(i % 4 == 0)) for i in range(120)] + [(None, 1)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    at = spark.read.parquet(f"{sf}/documents.parquet")
    toxic = {100 + i for i in range(0, 120, 4)} | {300 + i for i in range(0, 20, 4)}
    stage = dict(corpus_pipeline.STAGES)
    clean = stage["toxicity"](spark, at, sf)
    assert clean.columns == docs.columns and ids(clean) == sorted([i for i in ids(at) if i not in toxic], key=lambda x: (x is None, x))
    one = stage["near_dedup"](spark, clean, sf)
    # of copies the least id stays; texts without a word are copies of each other
    expected = [i for i in ids(clean) if i not in {2, 8} and (i or 0) < 300]
    expected.remove(4)  # two of its three rows are the same
    assert ids(one) == expected
    free = stage["decontamination"](spark, one, sf)
    assert ids(free) == [i for i in ids(one) if i != 6]
    mixed = stage["mixing"](spark, free, sf)
    assert mixed.columns == docs.columns and set(ids(mixed)) <= set(ids(free))
    out = stage["token_output"](spark, mixed, sf)
    assert ids(out) == ids(mixed)
    whole_run = corpus_pipeline.run(spark, sf)
    assert ids(whole_run) == ids(mixed)
    empty = str(tmp_path / "empty")
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
