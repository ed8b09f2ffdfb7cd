"""Toxicity by a factorization machine over hashed terms.

A linear model adds up terms one by one; here each term also has a short factor vector, and the product of two
terms' vectors adds what they mean together: a second insult, or an insult beside a group's name, where one quoted word means
little. The machine is fitted on the driver from a bounded sample of labelled rows, broadcast (bounded by the hash space), and
scores whole texts where they are read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import held, unit_hash


#: Lengths of the word beginnings that are terms beside whole words: inflected forms of one stem share them.
STEMS = (4, 5, 6)


class _Terms(dict):
    """Raw token to its hashed terms: the word in lower case without punctuation at its ends, and its beginnings. A bounded cache."""

    def __init__(self, bits: int, most: int = 100_000):
        import xxhash

        self.mask, self.hash, self.most = (1 << bits) - 1, xxhash.xxh64_intdigest, most

    def __missing__(self, token: str) -> tuple[int, ...]:
        first, last = 0, len(token)
        while first < last and not token[first].isalnum():
            first += 1
        while last > first and not token[last - 1].isalnum():
            last -= 1
        word = token[first:last]
        names = [(word, 0), *((word[:n], n) for n in STEMS if n <= len(word))] if word else []
        if len(self) >= self.most:
            self.clear()
        terms = self[token] = tuple(self.hash(x.encode("utf-8", "surrogatepass"), n) & self.mask for x, n in names)
        return terms


def counted_terms(terms: _Terms, text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct hashed terms with the value of each, 1 + ln(times); a term found twice or more also counts as a second term of its own, with value 1."""
    found = np.fromiter(chain.from_iterable(map(terms.__getitem__, (text or "").lower().split())), np.int64)
    kinds, times = np.unique(found, return_counts=True)
    again = np.unique(kinds[times > 1] * 2_654_435_761 + 97 & terms.mask)
    return np.concatenate([kinds, again]), np.concatenate([1.0 + np.log(times), np.ones(len(again))])


@dataclass
class FactorizationMachine:
    """score = sigmoid(bias + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j), over the terms listed in kinds."""

    bits: int
    kinds: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def places(self) -> np.ndarray:
        """From hashed terms to rows of w and v, -1 for terms that aren't in the model."""
        out = np.full(1 << self.bits, -1, np.int32)
        out[self.kinds] = np.arange(len(self.kinds))
        return out

    def scores(self, rows: np.ndarray, places: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        """Scores of n texts; text rows[j] holds the term at places[j] with values[j]. rows ascend."""
        z = np.full(n, self.bias)
        if len(rows):
            z += np.bincount(rows, self.w[places] * values, n)
            starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            vx = self.v[places] * values[:, None]
            pairs = (np.add.reduceat(vx, starts) ** 2 - np.add.reduceat(vx**2, starts)).sum(1) / 2
            z[rows[starts]] += pairs
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def telling_terms(texts: list[np.ndarray], labels: np.ndarray, bits: int, errors: float) -> np.ndarray:
    """Terms that labels differ by: those found in toxic texts more or less often than chance would have it by so many standard errors, among all texts, or (a group's name beside an insult, say)
    among the texts that hold one of the former."""

    def differ(some: np.ndarray) -> np.ndarray:
        all_of, toxic = np.zeros(1 << bits), np.zeros(1 << bits)
        for i in some.tolist():
            all_of[texts[i]] += 1
            toxic[texts[i]] += labels[i]
        p = labels[some].mean() if len(some) else 0.0
        return np.flatnonzero(np.abs(toxic - p * all_of) > errors * np.sqrt(np.maximum(p * (1 - p), 1e-9) * all_of)) if 0 < p < 1 else np.zeros(0, np.int64)

    first = differ(np.arange(len(texts)))
    holds = np.flatnonzero([bool(np.isin(t, first).any()) for t in texts]) if len(first) else np.zeros(0, np.int64)
    return np.union1d(first, differ(holds))


def fit(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, *, bits: int, factors: int = 4, epochs: int = 10, batch: int = 128, rate: float = 0.1, penalty: float = 2e-2, errors: float = 5.0, seed: int = 17) -> FactorizationMachine:
    """Fits by AdaGrad on the logistic loss the weights of telling_terms(); without both labels, or without such terms, the score is the labels' rate."""
    rng = np.random.default_rng(seed)
    kinds = telling_terms([k for k, _ in features], labels, bits, errors)
    p = (float(labels.sum()) + 0.5) / (len(labels) + 1)
    m = FactorizationMachine(bits, kinds, float(np.log(p / (1 - p))), np.zeros(len(kinds)), rng.normal(0, 0.05, (len(kinds), factors)))
    if not len(kinds) or labels.min() == labels.max():
        m.v[:] = 0
        return m
    at = m.places()
    data = []
    for k, x in features:
        place = at[k]
        data.append((place[place >= 0], x[place >= 0]))
    gw, gv, gb = np.full(len(kinds), 1e-3), np.full((len(kinds), factors), 1e-3), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for lo in range(0, len(order), batch):
            mine = order[lo : lo + batch]
            n = [len(data[i][0]) for i in mine]
            rows, places, x = np.repeat(np.arange(len(mine)), n), np.concatenate([data[i][0] for i in mine]), np.concatenate([data[i][1] for i in mine])
            error = (m.scores(rows, places, x, len(mine)) - labels[mine]) / len(mine)
            touched, inverse = np.unique(places, return_inverse=True)
            e = error[rows] * x
            dw = np.bincount(inverse, e, len(touched)) + penalty / len(order) * batch * m.w[touched]
            sums = np.zeros((len(mine), factors))
            vx = m.v[places] * x[:, None]
            if len(rows):
                starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                sums[rows[starts]] = np.add.reduceat(vx, starts)
            each = e[:, None] * (sums[rows] - vx)
            dv = np.stack([np.bincount(inverse, each[:, f], len(touched)) for f in range(factors)], 1) + penalty / len(order) * batch * m.v[touched]
            db = error.sum()
            gw[touched] += dw**2
            gv[touched] += dv**2
            gb += db**2
            m.w[touched] -= rate * dw / np.sqrt(gw[touched])
            m.v[touched] -= rate * dv / np.sqrt(gv[touched])
            m.bias -= rate * db / gb**0.5
    return m


def train(docs: DataFrame, labels: DataFrame, *, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = 10_000, bits: int = 20, seed: int = 17, **options) -> FactorizationMachine:
    """Fits on the labelled rows for which usable (an expression on id_col, default: all) holds: all of them, or most_rows chosen by a hash of the id.

    Rows with a null id or label are left out; an id with several labels counts as toxic if one says so. The chosen ids, at most
    most_rows, are broadcast to the texts, so no text is shuffled. Only hashed terms and their values come to the driver: those of most_rows rows at most (if ids have several
    rows, the first in the order of id, label and terms), each of 2^bits terms at most.
    """
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    if usable is not None:
        chosen = chosen.where(usable)
    chosen = chosen.groupBy("id").agg(F.max("y").alias("y")).orderBy(unit_hash(seed, F.col("id")), "id").limit(most_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id").select("id", "y", "text")

    def features(batches):
        import pyarrow as pa

        terms = held(("terms", bits), lambda: _Terms(bits))
        for b in _small(batches):
            found = [counted_terms(terms, t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.string()), b.column("y"), pa.array([k.astype("<i4").tobytes() for k, _ in found], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in found], pa.binary())], ["id", "y", "kinds", "x"])

    rows = texts.mapInArrow(features, "id string, y int, kinds binary, x binary").orderBy("id", "y", "kinds").limit(most_rows).collect()
    got = [(np.frombuffer(r.kinds, "<i4"), np.frombuffer(r.x, "<f4")) for r in rows]
    return fit(got, np.array([r.y for r in rows], float), bits=bits, seed=seed, **options)


def _small(batches, rows: int = 256):
    """The batches in slices, so that only a few texts' terms are held at once."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def score(docs: DataFrame, machine: FactorizationMachine, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """id_col, score (0 to 1) and predicted (1 if score >= threshold) of each row of docs, whose other columns may have any names.

    A text of any length is scored whole; a null or empty one gets the model's bias. Repeated rows give repeated rows; an empty table gives none.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    judge = _judge(rows, machine)

    def run(batches):
        import pyarrow as pa

        for b in _small(batches):
            s = judge(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double, predicted int").withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, machine: FactorizationMachine, *, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score below threshold, as they are: columns go by place, so they may have any names."""
    names, rows = docs.columns, docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text, judge = f"c{docs.columns.index(text_col)}", _judge(docs, machine)

    def run(batches):
        import pyarrow as pa

        for b in _small(batches):
            yield b.filter(pa.array(judge(b.column(text)) < threshold, pa.bool_()))

    return rows.mapInArrow(run, rows.schema).toDF(*names)


def _judge(docs: DataFrame, machine: FactorizationMachine):
    """A function for the workers: scores of a column of texts."""
    sent, key = docs.sparkSession.sparkContext.broadcast(machine), uuid.uuid4().hex

    def judge(texts) -> np.ndarray:
        model, places, terms = held(("toxicity", key), lambda: (sent.value, sent.value.places(), _Terms(sent.value.bits)))
        found = [counted_terms(terms, t) for t in texts.to_pylist()]
        if not found:
            return np.zeros(0)
        n = [len(k) for k, _ in found]
        rows, at = np.repeat(np.arange(len(n)), n), places[np.concatenate([k for k, _ in found])]
        return model.scores(rows[at >= 0], at[at >= 0], np.concatenate([x for _, x in found])[at >= 0], len(n))

    return judge
