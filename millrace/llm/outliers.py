"""Robust multivariate outliers among texts' statistics [native: DataFrame functions only].

Five statistics of each text are transformed to a vector. Per language and source a minimum-covariance-determinant estimate is found: from each of the STARTS
concentration steps keep the share of vectors nearest to the mean by Mahalanobis distance; after FIRST_STEPS of them the start with the lowest determinant goes on
until its log-determinant falls by no more than SETTLED, and one reweighting step follows. A determinant has a floor and must fall by more than SETTLED for another step, so the steps end.
A text is rejected when its squared distance exceeds a quantile of the chi-squared law.

A step is two aggregations over a narrow table of vectors (never over texts): counts of distances by fine bins find the bin in which each
group's share ends, then exact integer sums of what lies below it and of what lies in it, the latter weighted by the part of it that the share takes, give the moments. Nothing is sorted within
a group, so a hot language or source is added up map-side. Groups that have settled leave the steps. Sums and medians are exact, so reruns agree.
Groups too small for a covariance are pooled by language, then all together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, group_key, kept

SYMBOLS = "[#*$%&|<>]"
P = 5
#: Vectors are held as whole numbers of this fraction, so that sums are exact and reruns agree.
UNIT = 1 << 12
#: Least standard deviation of each dimension: where most texts have the same value, a small difference is no outlier.
FLOOR = (0.6, 0.07, 0.25, 0.45, 0.08)
#: Bins of ln(squared distance) a unit.
BINS = 32
#: Starts: mean and covariance of all vectors; medians with spreads from quartiles; the same medians and spreads with the correlations of tanh(z), z the vector in spreads from the
#: medians; and with those of the spatial signs z / |z|. All but the first withstand outliers.
STARTS = ("all", "quartiles", "tanh", "signs")
#: Concentration steps before the best start is chosen.
FIRST_STEPS = 2
#: Least fall of the log-determinant for another step.
SETTLED = 1e-3


def base_statistics(text: Column) -> dict[str, Column]:
    """Columns of a text's statistics; null counts as empty. Words are runs without white space; lines are split at newlines."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, "[\\x20\\x09-\\x0D]+"), "")
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(WORD))
    return {"words": words, "lines": lines, "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long")}


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words that lie in a run of `width` words found twice or more in the text. Runs are compared by 64-bit hashes of their words.

    Texts without an equal run are told by one hash set. For others the runs are sorted with their places; those equal to a neighbour mark their
    places, and the marked places in order add what each run doesn't share with the one before.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def runs_of(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)]))

    def marked(runs: Column) -> Column:
        placed = F.sort_array(F.transform(runs, lambda r, i: F.struct(r.alias("r"), i.alias("i"))))
        kept_runs = once(placed, lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["r"] == x["r"]) | (F.get(s, i + 1)["r"] == x["r"])))
        places = F.array_sort(F.transform(kept_runs, lambda x: x["i"]))
        return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(width), i - a["last"])).alias("n"), i.alias("last")))["n"]

    def count(runs: Column) -> Column:
        return F.when(F.size(F.array_distinct(runs)) == F.size(runs), F.lit(0)).otherwise(marked(runs))

    return F.when(F.size(words) <= width, F.lit(0)).otherwise(once(hashes, lambda h: once(runs_of(h), count))).cast("long")


def once(value: Column, use) -> Column:
    """use(value) with value computed once a row: a lambda's argument isn't inlined."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id, language and source keys, the five statistics and base_failed of each row."""
    got = base_statistics(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), group_key(F.col(lang_col)).alias("lang"), group_key(F.col(source_col)).alias("source"), got["words"].alias("words"), got["lines"].alias("lines"), got["n_symbols"].alias("n_symbols"))
    rows = rows.select(
        "id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def vector() -> list[Column]:
    """The transformed statistics, as whole numbers of 1 / UNIT."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    parts = [F.log1p("n_words"), F.log((F.col("word_chars") + 1) / n), F.log1p(20 * F.col("n_symbols") / n), F.log1p("n_dup_lines"), F.sqrt(F.col("n_repeat_words") / n)]
    return [F.round(x * UNIT).cast("long").alias(f"x{i}") for i, x in enumerate(parts)]


PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def moments(prefix: str, inside: str = "true") -> list[Column]:
    """Count, sums and sums of products of the vectors for which inside (SQL) holds, exact. These and the columns below are built from SQL text: hundreds of column objects would take the driver longer than the work itself."""
    sums = [f"count_if({inside}) AS {prefix}n"]
    sums += [f"sum(CAST(CASE WHEN {inside} THEN x{i} END AS decimal(18,0))) AS {prefix}s{i}" for i in range(P)]
    return [F.expr(e) for e in sums + [f"sum(CAST(CASE WHEN {inside} THEN x{i} * x{j} END AS decimal(20,0))) AS {prefix}s{i}_{j}" for i, j in PAIRS]]


def covariance(df: DataFrame, prefix: str, widen: float = 1.0, partly: str | None = None) -> DataFrame:
    """Adds mean m_i and covariance c_i_j (times widen, with the floors) from the moments named by prefix, plus column `part` of those named by `partly`."""

    def total(what: str) -> str:
        value = f"coalesce(CAST({prefix}{what} AS double), 0D)"
        return value if partly is None else f"({value} + part * coalesce(CAST({partly}{what} AS double), 0D))"

    n = [f"greatest({total('n')}, 1D) AS _n"]
    means = [f"{total(f's{i}')} / _n / {UNIT} AS m{i}" for i in range(P)]
    floor = lambda i, j: f"{FLOOR[i] ** 2!r}D" if i == j else "0D"
    return df.selectExpr("*", *n, *means, *[f"({total(f's{i}_{j}')} / _n / {UNIT} / {UNIT} - m{i} * m{j}) * {widen!r}D + {floor(i, j)} AS c{i}_{j}" for i, j in PAIRS])


def factored(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns, the means, and from the covariance c_i_j its Cholesky factor l_i_j and log-determinant det."""
    steps = []
    for j in range(P):  # column by column
        left = "".join(f" - l{j}_{k} * l{j}_{k}" for k in range(j))
        steps.append(f"sqrt(greatest(c{j}_{j}{left}, 1e-6D)) AS l{j}_{j}")
        for i in range(j + 1, P):
            left = "".join(f" - l{j}_{k} * l{i}_{k}" for k in range(j))
            steps.append(f"(c{j}_{i}{left}) / l{j}_{j} AS l{i}_{j}")
    return df.selectExpr("*", *steps).selectExpr(*columns, *SHAPE[:-1], "2 * (" + " + ".join(f"ln(l{j}_{j})" for j in range(P)) + ") AS det")


SHAPE = [f"m{i}" for i in range(P)] + [f"l{i}_{j}" for j in range(P) for i in range(j, P)] + ["det"]


def distance(df: DataFrame, to: str) -> DataFrame:
    """Adds the squared Mahalanobis distance: forward substitution through the Cholesky factor."""
    steps = []
    for i in range(P):
        left = "".join(f" - l{i}_{k} * _z{k}" for k in range(i))
        steps.append(f"(x{i} / {float(UNIT)!r}D - m{i}{left}) / l{i}_{i} AS _z{i}")
    return df.selectExpr("*", *steps, " + ".join(f"_z{i} * _z{i}" for i in range(P)) + f" AS {to}").drop(*[f"_z{i}" for i in range(P)])


def every_salt(salts: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")


def measured(vectors: DataFrame, shapes: DataFrame, salts: int, *columns: str) -> DataFrame:
    """Each vector with its squared distance d2 under each shape of its group, and the bin of that distance."""
    out = distance(vectors.join(shapes.select("g", *columns, *SHAPE, every_salt(salts)), ["g", "salt"]), "d2")
    return out.withColumn("bin", F.floor(F.log(F.col("d2") + 1e-9) * BINS))


def starts(vectors: DataFrame, salts: int) -> DataFrame:
    """g, total, s and a shape for each group and start."""
    # exact percentiles count distinct values, of which a dimension has at most its range times UNIT
    quartiles = [F.expr(f"percentile(x{i}, array(0.25, 0.5, 0.75)) AS q{i}") for i in range(P)]
    first = kept(vectors.groupBy("g").agg(*moments(""), *quartiles), "starts")
    spreads = [f"sqrt(pow((q{i}[2] - q{i}[0]) / {UNIT} / 1.349D, 2) + {FLOOR[i] ** 2!r}D) AS w{i}" for i in range(P)]
    mids = first.selectExpr("g", "n AS total", *[f"q{i}[1] / {UNIT} AS m{i}" for i in range(P)], *spreads)
    rows = vectors.join(mids.select("*", every_salt(salts)), ["g", "salt"])
    rows = rows.selectExpr("g", *[f"(x{i} / {float(UNIT)!r}D - m{i}) / w{i} AS z{i}" for i in range(P)], "sqrt(" + " + ".join(f"z{i} * z{i}" for i in range(P)) + ") AS far")
    columns = ["g", "total", "s", *[f"m{i}" for i in range(P)]]

    def of(name: str, value: str) -> DataFrame:  # exact sums of whole numbers, so that reruns agree
        ys = rows.selectExpr("g", *[f"CAST(round({value.format(f'z{i}')} * {UNIT}) AS long) AS x{i}" for i in range(P)])
        inner = lambda i, j: f"(CAST(s{i}_{j} AS double) + {1e-3 if i == j else 0.0}D)"
        scaled = [f"{inner(i, j)} / sqrt({inner(i, i)} * {inner(j, j)}) * w{i} * w{j} AS c{i}_{j}" for i, j in PAIRS]
        return ys.groupBy("g").agg(*moments("")).join(mids, "g").selectExpr("*", f"'{name}' AS s").selectExpr(*columns, *scaled)

    every = covariance(first, "").selectExpr("*", "n AS total", f"'{STARTS[0]}' AS s")
    plain = mids.selectExpr("*", f"'{STARTS[1]}' AS s", *[f"w{i} * w{i} AS c{i}_{j}" if i == j else f"0D AS c{i}_{j}" for i, j in PAIRS])
    columns_of = [*columns, *[f"c{i}_{j}" for i, j in PAIRS]]
    out = every.select(columns_of).unionByName(plain.select(columns_of)).unionByName(of(STARTS[2], "tanh({})")).unionByName(of(STARTS[3], "CASE WHEN far > 0 THEN {} / far ELSE 0D END"))
    return kept(factored(out, "g", "total", "s"), "shapes")


def concentrated(vectors: DataFrame, shapes: DataFrame, share: float, salts: int) -> DataFrame:
    """One concentration step: for each row of shapes (g, total, s) the shape of the share of vectors nearest under it, and `fall`, by how much its log-determinant fell."""
    counts = measured(vectors, shapes, salts, "s").groupBy("g", "s", "bin").count()
    counts = counts.selectExpr("*", "sum(count) OVER (PARTITION BY g, s ORDER BY bin) - count AS before", f"ceil({share!r}D * sum(count) OVER (PARTITION BY g, s)) AS need")
    cuts = counts.where("before < need AND need <= before + count").selectExpr("g", "s", "bin AS cut", "(need - before) / count AS part")
    cuts = shapes.join(cuts, ["g", "s"])
    inside = measured(vectors, cuts, salts, "s", "cut").where("bin <= cut")
    sums = inside.groupBy("g", "s").agg(*moments("b", "bin < cut"), *moments("e", "bin = cut"))
    new = covariance(sums.join(cuts.selectExpr("g", "s", "total", "part", "det AS was"), ["g", "s"]), "b", partly="e")
    return kept(factored(new, "g", "total", "s", "was").selectExpr("g", "total", "s", *SHAPE, "was - det AS fall"), "shapes")


def determinants(vectors: DataFrame, *, share: float, salts: int) -> DataFrame:
    """g, total, s and the settled shape of the best start s of each group in vectors (g, salt, x_i)."""
    shapes = starts(vectors, salts)
    for _ in range(FIRST_STEPS):
        shapes = concentrated(vectors, shapes, share, salts)
    best = Window.partitionBy("g").orderBy("det", "s")  # as many rows as there are starts
    going = shapes.withColumn("place", F.row_number().over(best)).where("place = 1").select("g", "total", "s", *SHAPE)
    settled = None
    while True:
        step = concentrated(vectors, going, share, salts)
        still = step.where(F.col("fall") <= SETTLED).drop("fall")
        settled = still if settled is None else settled.unionByName(still)
        going = step.where(F.col("fall") > SETTLED).drop("fall")
        if going.isEmpty():
            return settled


def chi2_below(x: float, k: int = P) -> float:
    """The chi-squared law's distribution function: the regularised lower incomplete gamma function as a series, whose terms fall once n exceeds x / 2."""
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-17:
        n += 1
        term *= z / (a + n)
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a))


def chi2_quantile(p: float, k: int = P) -> float:
    """Quantile of the chi-squared law by bisection."""
    lo, hi = 1e-9, 500.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_below(mid, k) < p else (lo, mid)
    return (lo + hi) / 2


def consistency(share: float) -> float:
    """What the covariance of the share nearest to the mean of a normal law must be multiplied by."""
    return share / chi2_below(chi2_quantile(share), P + 2) if share < 1 else 1.0


def outliers(docs: DataFrame, *, share: float = 0.75, reweigh: float = 0.975, reject: float = 1 - 1e-7, least: int = 50, salts: int = 16, **columns) -> DataFrame:
    """One row for each row of docs: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance2, kept.

    base_failed: fewer than 10 words, or over a fifth of them in repeated five-word runs. Estimates use the rows that pass; kept is false for the others and for those
    whose squared distance exceeds the chi-squared quantile `reject`. Groups with fewer than `least` such rows are pooled by language, then all together; if even those
    are fewer, what passes the base rules is kept with a null distance. A null text has no words and fails; null languages and sources are groups of their own; repeated rows
    are judged each; an empty table gives no rows. Statistics groups are joined to vectors by (group, salt), so a hot group is dealt over `salts` keys.
    """
    id_col = columns.get("id_col", "doc_id")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    stats = kept(statistics(docs, **columns), "statistics")
    good = stats.where(~F.col("base_failed"))
    sizes = good.groupBy("lang", "source").count()
    by_lang = Window.partitionBy("lang")
    own = F.col("count") >= least
    sizes = sizes.withColumn("rest", F.sum(F.when(own, 0).otherwise(F.col("count"))).over(by_lang))
    group = F.when(own, F.concat_ws("\n", "lang", "source")).when(F.col("rest") >= least, F.col("lang")).otherwise(F.lit(""))
    places = sizes.select("lang", "source", group.alias("g"))
    salt = F.pmod(F.xxhash64("id", "n_words", "word_chars"), F.lit(salts)).cast("int").alias("salt")
    rows = stats.select("id", *names, "lang", "source", salt, *vector())
    rows = kept(rows.join(places.select("*", every_salt(salts)), ["lang", "source", "salt"], "left").select("id", *names, "salt", "g", *[f"x{i}" for i in range(P)]), "vectors")
    vectors = rows.where("NOT base_failed").select("g", "salt", *[f"x{i}" for i in range(P)])
    raw = determinants(vectors, share=share, salts=salts)
    # made consistent with the normal law; then one reweighting step
    factor = math.sqrt(consistency(share))
    raw = raw.select("g", "total", *[(F.col(c) * factor if c.startswith("l") else F.col(c)).alias(c) for c in SHAPE])
    weighed = measured(vectors, raw, salts, "total").where(F.col("d2") <= chi2_quantile(reweigh)).groupBy("g", "total").agg(*moments(""))
    final = kept(factored(covariance(weighed.where(F.col("total") >= least), "", consistency(reweigh)), "g"), "final")
    judged = distance(rows.join(final.select("*", every_salt(salts)), ["g", "salt"], "left"), "d2")
    passes = ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= chi2_quantile(reject))
    return judged.select(F.col("id").alias(id_col), *names, F.when(~F.col("base_failed"), F.col("d2")).alias("distance2"), passes.alias("kept"))
