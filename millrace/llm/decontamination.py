"""Benchmark decontamination: a BM25 index of test items, searched by every passage of every text with block-max WAND.

The index holds the items (in pieces of at most PIECE tokens), each posting with its BM25 weight divided by the piece's own best
score, so that 1 is a perfect match and one threshold serves all. A passage retrieves every piece at or above the threshold: WAND skips what the
terms' greatest weights cannot lift there, the blocks' greatest weights skip more, and nothing is cut at a rank. What is
retrieved is verified exactly: the five-word shingles of an item's question and of its answer must both be in the text. An answer of at
most SHORT tokens counts as well by its tokens in order where the question's match says that it should stand.
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import held

K1, B = 1.2, 0.75
PIECE = 64  # tokens of an indexed piece; passages hold twice as many and begin every PIECE tokens, so each piece's length lies whole in one
BLOCK = 16  # postings of a block
MOST_BLOCKS = 256  # columns of the table of blocks' greatest weights
LONG = 1 << 16  # tokens of a text looked at together
SHORT = 8  # tokens of an answer that has too few shingles to outlast a changed word


def token_key(token: str) -> str:
    """A token in lower case without what isn't a letter or digit at its ends; may be empty, and is then no token."""
    first, last = 0, len(token)
    while first < last and not token[first].isalnum():
        first += 1
    while last > first and not token[last - 1].isalnum():
        last -= 1
    return token[first:last].lower()


def item_parts(text: str) -> tuple[list[str], int]:
    """An item's tokens and where its answer begins: after the last sentence end (or colon) that has tokens behind it, else at the last quarter."""
    tokens, ends = [], []
    for raw in text.split():
        key = token_key(raw)
        if key:
            tokens.append(key)
        if raw[-1] in ".?!:" and tokens:
            ends.append(len(tokens))
    ends = [e for e in ends if e < len(tokens)]
    return tokens, ends[-1] if ends else len(tokens) - max(1, len(tokens) // 4)


def shingles(tokens: list, width: int = 5) -> set[tuple]:
    """Distinct runs of width tokens; of all tokens if there are fewer."""
    width = min(width, len(tokens))
    return {tuple(tokens[i : i + width]) for i in range(len(tokens) - width + 1)} if width else set()


def in_order(answer: list, window: list) -> int:
    """Most tokens of answer that stand in window in their order (longest common subsequence)."""
    row = [0] * (len(window) + 1)
    for a in answer:
        before, row = row, [0]
        for j, w in enumerate(window):
            row.append(before[j] + 1 if a == w else max(before[j + 1], row[j]))
    return row[-1]


def beside(question: list, answer: list, text: list) -> float:
    """Greatest share of the answer's tokens that stand in order where one of the question's shingles in the text expects the answer, give or take its length."""
    width = min(5, len(question))
    at: dict[tuple, list[int]] = {}
    for i in range(len(question) - width + 1 if width else 0):
        at.setdefault(tuple(question[i : i + width]), []).append(len(question) - i)
    starts = {i + ahead for i in range(len(text) - width + 1) for ahead in at.get(tuple(text[i : i + width]), ())}
    n = len(answer)
    return max((in_order(answer, text[max(0, s - n) : s + 2 * n]) / n for s in starts), default=0.0)


class Index:
    """Items as an inverted index with normalised weights and block maxima. items: (id, text); those without a token are left out."""

    def __init__(self, items: list[tuple], threshold: float):
        self.threshold = threshold
        self.ids, self.parts, self.tokens, pieces = [], [], [], []
        self.terms: dict[str, int] = {}
        for item_id, text in items:
            tokens, answer = item_parts(text or "")
            if not tokens:
                continue
            t = [self.terms.setdefault(x, len(self.terms)) for x in tokens]
            for lo in range(0, max(1, len(t)), PIECE):
                pieces.append((len(self.ids), t[lo : lo + PIECE]))
            self.ids.append(item_id)
            self.parts.append((shingles(t[:answer]), shingles(t[answer:])))
            self.tokens.append((t[:answer], t[answer:]))
        self.owner = [i for i, _ in pieces]
        lists: dict[int, dict[int, int]] = {}
        for p, (_, t) in enumerate(pieces):
            for x in t:
                of = lists.setdefault(x, {})
                of[p] = of.get(p, 0) + 1
        mean = sum(len(t) for _, t in pieces) / max(1, len(pieces))
        size = [len(t) for _, t in pieces]
        weights = {x: [(p, math.log(1 + (len(pieces) - len(of) + 0.5) / (len(of) + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * size[p] / mean))) for p, n in of.items()] for x, of in lists.items()}
        best = [0.0] * len(pieces)
        for of in weights.values():
            for p, w in of:
                best[p] += w
        #: By term: pieces, weights, greatest weight, and of each block the last piece and the greatest weight.
        self.postings = {}
        for x, of in weights.items():
            ps, ws = [p for p, _ in of], [w / best[p] for p, w in of]
            last = [ps[min(i + BLOCK, len(ps)) - 1] for i in range(0, len(ps), BLOCK)]
            top = [max(ws[i : i + BLOCK]) for i in range(0, len(ws), BLOCK)]
            self.postings[x] = ps, ws, max(ws), last, top
        # Blocks of pieces, at most MOST_BLOCKS: by term and block the greatest weight. Frequent terms are left out there; what they can
        # give any piece of the block together, however many of them a passage holds, is a constant of the block.
        n = len(pieces)
        self.wide = max(4, -(-n // MOST_BLOCKS))
        self.n_blocks = -(-n // self.wide)
        self.block_most = np.zeros((len(self.terms) + 1, self.n_blocks), np.float32)  # the last row is that of no term
        given = np.zeros(n)
        for x, (ps, ws, *_) in self.postings.items():
            if len(ps) > max(2, n // 50):
                given[ps] += ws
            else:
                np.maximum.at(self.block_most[x], np.array(ps) // self.wide, np.array(ws, np.float32))
        self.common_most = np.array([given[i : i + self.wide].max() for i in range(0, n, self.wide)])

    def passages(self, ids: np.ndarray) -> dict[int, list[int]]:
        """By the start of a passage: the blocks of which it may reach a piece, going by the greatest weights of its terms. ids: a text's tokens, -1 where unknown."""
        out: dict[int, list[int]] = {}
        if not len(ids) or not self.n_blocks:
            return out
        least = self.threshold - 1e-5 - self.common_most
        for at in range(0, len(ids), LONG):  # a long text in parts that overlap by a passage
            part = ids[at : at + LONG + 2 * PIECE]
            held = np.add.reduceat(self.block_most[part], np.arange(0, len(part), PIECE), axis=0)
            held[:-1] += held[1:]
            # counted once for each time a term stands there, which can only be too much; then once for each term
            for k in np.flatnonzero((held >= least).any(1)).tolist():
                lo = at + k * PIECE
                here = np.unique(ids[lo : lo + 2 * PIECE])
                blocks = np.flatnonzero(self.block_most[here].sum(0) >= least)
                if len(blocks):
                    out[lo] = blocks.tolist()
        return out

    def search(self, terms: list[int], block: int) -> list[tuple[int, float]]:
        """Every piece of a block that a passage with these distinct terms reaches the threshold with, and its score: block-max WAND with a fixed threshold."""
        least, end = self.threshold - 1e-9, (block + 1) * self.wide
        cursors = []
        for x in terms:
            of = self.postings[x]
            at = bisect_left(of[0], block * self.wide)
            if at < len(of[0]) and of[0][at] < end:
                cursors.append([of[0][at], at, of])
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            total = 0.0
            for k, c in enumerate(cursors):
                total += c[2][2]
                if total >= least:
                    break
            else:
                break
            pivot = cursors[k][0]
            while k + 1 < len(cursors) and cursors[k + 1][0] == pivot:
                k += 1
            blocks = [bisect_left(c[2][3], pivot) for c in cursors[: k + 1]]
            if sum(c[2][4][b] for c, b in zip(cursors, blocks, strict=False) if b < len(c[2][4])) < least:
                # no piece up to the nearest end of these blocks, and before the next list's piece, can get there
                to = min([c[2][3][b] for c, b in zip(cursors, blocks, strict=False) if b < len(c[2][3])] or [pivot]) + 1
                if k + 1 < len(cursors):
                    to = min(to, cursors[k + 1][0])
                cursors = self._move(cursors, k, max(to, pivot + 1), end)
            elif cursors[0][0] == pivot:
                score = sum(c[2][1][c[1]] for c in cursors[: k + 1])
                if score >= least:
                    found.append((pivot, score))
                cursors = self._move(cursors, k, pivot + 1, end)
            else:
                cursors = self._move(cursors, k, pivot, end)
        return found

    @staticmethod
    def _move(cursors: list, k: int, to: int, end: int) -> list:
        """Moves cursors 0 to k to the first piece at or after to; drops those that come to end."""
        kept = []
        for i, c in enumerate(cursors):
            if i <= k and c[0] < to:
                c[1] = bisect_left(c[2][0], to, c[1])
                if c[1] == len(c[2][0]) or c[2][0][c[1]] >= end:
                    continue
                c[0] = c[2][0][c[1]]
            kept.append(c)
        return kept

    def matches(self, ids: np.ndarray, overlap: float) -> list[tuple]:
        """(item id, score, question overlap, answer overlap) of each item that a text of these tokens holds."""
        best: dict[int, float] = {}
        for lo, blocks in self.passages(ids).items():
            here = np.unique(ids[lo : lo + 2 * PIECE])
            terms = here[here >= 0].tolist()
            for piece, score in (x for block in blocks for x in self.search(terms, block)):
                item = self.owner[piece]
                best[item] = max(best.get(item, 0.0), score)
        if not best:
            return []
        runs: dict[int, set[tuple]] = {}
        whole, out = ids.tolist(), []
        for item, score in sorted(best.items()):
            shares = []
            for part in self.parts[item]:
                width = len(next(iter(part), ()))
                if width not in runs:
                    runs[width] = {tuple(whole[i : i + width]) for i in range(len(whole) - width + 1)}
                shares.append(len(part & runs[width]) / len(part) if part else 1.0)
            question, answer = self.tokens[item]
            if shares[1] < overlap <= shares[0] and len(answer) <= SHORT:
                shares[1] = max(shares[1], beside(question, answer, whole))
            if min(shares) >= overlap:
                out.append((self.ids[item], score, *shares))
        return out


class _Ids(dict):
    """Raw token to its term in an index, -1 if it has none, -2 if it is no token: a bounded cache."""

    def __init__(self, terms: dict[str, int], most: int = 500_000):
        self.terms, self.most = terms, most

    def __missing__(self, raw: str) -> int:
        key = token_key(raw)
        if len(self) >= self.most:
            self.clear()
        term = self[raw] = self.terms.get(key, -1) if key else -2
        return term


def _found(key: str, sent, texts: list[str | None], overlap: float) -> list[list[tuple]]:
    """What each text holds of the index that a worker keeps under key."""
    index, lookup = held(("index", key), lambda: (sent.value, _Ids(sent.value.terms)))
    out = []
    for text in texts:
        tokens = (text or "").split()
        ids = np.fromiter(map(lookup.__getitem__, tokens), np.int64, len(tokens))
        out.append(index.matches(ids[ids != -2], overlap))
    return out


def _blocks(benchmark: DataFrame, item_id_col: str, item_text_col: str, block_mb: float):
    """The benchmark as DataFrames (item, text) of about block_mb at most: its size is looked up, then items are dealt by a hash."""
    items = benchmark.select(F.col(item_id_col).alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(total / (block_mb * 1e6)))
    return [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) for k in range(blocks)]


def _index(items: DataFrame, threshold: float):
    index = Index([(r.item, r.text) for r in items.orderBy("item", "text").collect()], threshold)
    return items.sparkSession.sparkContext.broadcast(index), uuid.uuid4().hex


def _block_matches(docs: DataFrame, items: DataFrame, threshold: float, overlap: float) -> DataFrame:
    """Matches of all docs(id, text) with one block of items(item, text), small enough for each worker to hold."""
    from pyspark.sql.pandas.types import to_arrow_type

    sent, key = _index(items, threshold)
    item_type = to_arrow_type(items.schema["item"].dataType)

    def search(batches):
        import pyarrow as pa

        for b in batches:
            found = _found(key, sent, b.column("text").to_pylist(), overlap)
            rows = [x for got in found for x in got]
            if rows:
                item, score, question, answer = zip(*rows, strict=True)
                at = np.repeat(np.arange(len(found)), [len(got) for got in found])
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), pa.array(item, item_type), pa.array(score, pa.float64()), pa.array(question, pa.float64()), pa.array(answer, pa.float64())], ["id", "item", "score", "question_overlap", "answer_overlap"])

    return docs.mapInArrow(search, f"id {docs.schema['id'].dataType.simpleString()}, item {items.schema['item'].dataType.simpleString()}, score double, question_overlap double, answer_overlap double")


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.5, overlap: float = 0.8, block_mb: float = 8.0) -> DataFrame:
    """One row for each text and benchmark item it holds: id_col, item_id_col, score (share of the item's best BM25 score), question_overlap, answer_overlap.

    Texts are split at white space, lower-cased and freed of punctuation at the tokens' ends. The benchmark's size is looked up first: beyond block_mb of text it is searched in
    blocks dealt by a hash of the item, one after another, each against all docs, so what a worker holds is bounded.
    A null or empty text holds nothing; an item without a token is never held; repeated rows give repeated rows; either table may be
    empty. Only the named columns are read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for items in _blocks(benchmark, item_id_col, item_text_col, block_mb):
        found = _block_matches(rows, items, threshold, overlap)
        out = found if out is None else out.unionAll(found)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_id_col), "score", "question_overlap", "answer_overlap")


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.5, overlap: float = 0.8, block_mb: float = 8.0) -> DataFrame:
    """docs without the rows whose text holds a benchmark item, its columns as they are. Rows are dropped where they are read: nothing is joined."""
    names, out = docs.columns, docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = f"c{names.index(text_col)}"
    for items in _blocks(benchmark, item_id_col, item_text_col, block_mb):
        out = out.mapInArrow(_dropper(*_index(items, threshold), text, overlap), out.schema)
    return out.toDF(*names)


def _dropper(sent, key: str, text: str, overlap: float):
    def drop(batches):
        import pyarrow as pa

        for b in batches:
            yield b.filter(pa.array([not got for got in _found(key, sent, b.column(text).cast(pa.string()).to_pylist(), overlap)], pa.bool_()))

    return drop
