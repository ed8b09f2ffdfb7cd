"""op2's statistics and estimates against plain Python and numpy."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import outliers as o

SCHEMA = "doc_id long, text string, lang string, source string"


def plain(text):
    """The contract's statistics, straight from its words."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    marked = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 5)}
    n = len(words)
    out = (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked))
    return (*out, n < 10 or 100 * out[4] > 20 * n)


def vector(s):
    n = max(s[0], 1)
    x = np.array([np.log1p(s[0]), np.log((s[1] + 1) / n), np.log1p(20 * s[2] / n), np.log1p(s[3]), np.sqrt(s[4] / n)])
    return np.round(x * o.UNIT) / o.UNIT


def spread(x):
    return np.atleast_2d(np.cov(x.T, bias=True)) + np.diag(np.array(o.FLOOR) ** 2)


def squared(x, mean, cov):
    return np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)


def settle(x, h, mean, cov):
    """Plain concentration steps with the h nearest vectors, until they stay."""
    last = None
    while True:
        near = np.sort(np.argsort(squared(x, mean, cov), kind="stable")[:h])
        if last is not None and (near == last).all():
            return np.linalg.slogdet(cov)[1], mean, cov
        last, mean, cov = near, x[near].mean(axis=0), spread(x[near])


def made(rng, lang, source, rows, bad):
    """Texts of a group: the first `bad` share are long-worded, full of symbols and of equal lines."""
    out = []
    for i in range(rows):
        odd = i < bad * rows
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(14, 30) if odd else rng.randint(2, 9))) for _ in range(rng.randint(60, 90) if odd else int(np.exp(rng.gauss(5, 0.6))) + 12)]
        for _ in range(rng.randint(40, 80) if odd else rng.randint(0, 2)):
            words[rng.randrange(len(words))] += rng.choice("#*$%&|<>")
        lines = [" ".join(words[j : j + 12]) for j in range(0, len(words), 12)]
        lines += ["again here"] * (rng.randint(6, 9) if odd else 0)
        out.append((" ".join(lines) if rng.random() < 0.1 else "\n".join(lines), lang, source))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    got = made(rng, "en", "a", 400, 0.2) + made(rng, "en", "b", 150, 0.1) + made(rng, "fr", None, 90, 0.0) + made(rng, "fr", "few", 9, 0.0)
    got += [("", "en", "a"), (None, "en", "a"), ("short text", "en", "a"), ("one two three four five six\n" * 30, "en", "b"), ("é ü 文字 " * 9, "en", "b")]
    return [(i, *r) for i, r in enumerate(got)]


@pytest.fixture(scope="module")
def results(spark, rows):
    return {r.doc_id: r for r in o.outliers(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}


def test_statistics_are_those_of_plain_python(rows, results):
    assert len(results) == len(rows)
    for i, text, _, _ in rows:
        r = results[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(text), i


def groups(rows):
    out = {}
    for i, text, lang, source in rows:
        s = plain(text)
        if not s[-1]:
            out.setdefault((lang, source if source != "few" else "pooled"), []).append((i, vector(s)))
    return out


def test_determinants_are_the_least_that_many_random_starts_find(spark, rows):
    """500 random starts of a plain search find no set of vectors with a clearly lower determinant, though a fifth of a group are outliers."""
    rng = np.random.default_rng(3)
    by_group = {k: v for k, v in groups(rows).items() if len(v) >= 50}
    flat = [("/".join(map(str, k)), i % 16, *[int(round(c * o.UNIT)) for c in x]) for k, v in by_group.items() for i, x in v]
    vectors = spark.createDataFrame(flat, "g string, salt int, " + ", ".join(f"x{i} long" for i in range(o.P)))
    found = {r.g: r for r in o.determinants(vectors, share=0.75, salts=16).collect()}
    assert len(found) == len(by_group) == 3
    for k, v in by_group.items():
        x, r = np.array([c for _, c in v]), found["/".join(map(str, k))]
        h = int(np.ceil(0.75 * len(x)))
        best = np.inf
        for _ in range(500):
            few = x[rng.choice(len(x), o.P + 1, replace=False)]
            best = min(best, settle(x, h, few.mean(axis=0), spread(few))[0])
        assert r.det <= best + 0.02, (k, r.s, r.det, best)


def test_verdicts_are_those_of_a_plain_search(rows, results):
    rng = np.random.default_rng(4)
    limit, checked = o.chi2_quantile(1 - 1e-7), 0
    for (_, source), v in groups(rows).items():
        if len(v) < 50:
            continue
        x = np.array([c for _, c in v])
        h = int(np.ceil(0.75 * len(x)))
        tries = [settle(x, h, few.mean(axis=0), spread(few)) for few in (x[rng.choice(len(x), o.P + 1, replace=False)] for _ in range(100))]
        _, mean, cov = min(tries, key=lambda t: t[0])
        inner = x[squared(x, mean, cov * o.consistency(0.75)) <= o.chi2_quantile(0.975)]
        floors = np.diag(np.array(o.FLOOR) ** 2)
        cov = (spread(inner) - floors) * o.consistency(0.975) + floors
        for (i, _), d in zip(v, squared(x, inner.mean(axis=0), cov), strict=True):
            assert results[i].distance2 == pytest.approx(d, rel=0.1, abs=0.05), (source, i)
            if abs(d / limit - 1) > 0.1:
                assert results[i].kept == (d <= limit), (source, i, d)
                checked += 1
    assert checked > 600


def test_planted_outliers_go_and_plain_texts_stay(rows, results):
    planted = set(range(80)) | set(range(400, 415))
    whole = {i for i, r in results.items() if not r.base_failed}
    assert not any(results[i].kept for i in planted & whole)
    assert sum(not results[i].kept for i in whole - planted) <= 0.02 * len(whole)


def test_reruns_agree(spark, rows, results):
    again = o.outliers(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)).select("doc_id", F.col("distance2").alias("d"), "kept")
    assert {r.doc_id: (r.d, r.kept) for r in again.collect()} == {i: (r.distance2, r.kept) for i, r in results.items()}
