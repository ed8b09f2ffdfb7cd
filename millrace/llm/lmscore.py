"""LM scoring by online logistic context mixing.

A text is a row of symbols: frequent words, one symbol for any other word, and the end. A Huffman code turns each symbol into a few binary
decisions. Every decision is predicted by several hashed-context bit predictors: the code's node alone, the node after the last very frequent word (which tells
language and register), and the node after the two or three words before. Their log-odds are combined by weights that a gate chooses from what the
contexts have seen, and the weights are refined adaptively as the text goes on. Behind the symbol for other words one more mixed decision says whether it is the word that the context saw
most; else a word that the corpus knows costs its share of such words' counts, and a new one its bytes, spelled by a mixer of its own. The decisions'
probabilities multiply to the text's.

What is gathered from the corpus grows with it. Every word is counted and joined; every long context of every learning text is counted exactly, by a 64-bit hash, in
partitions whose number follows the count of tokens: chunks of texts send their distinct (context, symbol) pairs there, and get back what the learning texts hold on the path of each.
The same partitions tell, leaving out one occurrence at a time, what counts are worth: from that come the context's log-odds and the gates' first weights. Only what
is bounded by the alphabet of frequent words (most_words) is broadcast: their code, and a table of CLASSES rows.
"""

from __future__ import annotations

import heapq
import uuid
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import held, kept

#: Symbols that aren't frequent words: the end of a text, and any other word.
END, RARE, FIRST_WORD = 0, 1, 2
#: Short contexts: which of so many of the most frequent words stood last; 0 for none.
CLASSES = 32
#: A (context, symbol) pair is 32 bits of the context's hash and LOW bits: the symbol's place among the code's leaves, or RARE_BIT and hash bits of another word.
LOW, RARE_BIT = 24, 1 << 23
#: Tokens of a chunk, and of a partition of contexts.
CHUNK, PART = 400_000, 1_500_000
#: Symbols of a text before the weights are first refined, and between refinements.
FIRST_STEP, STEP = 16, 64
RATE = 0.02
#: Symbols of texts that are scored side by side: few enough for a core's cache.
GROUP = 40_000
#: Steps of a count that share a state: 0, 1, 2, 3, then from each bound on.
STATES = np.searchsorted([1, 2, 3, 4, 6, 9, 15, 31, 100], np.arange(101), side="right")
N_STATES = 10
#: Bins of the order-0 log-odds, of width 1 / 2, in what is gathered for the first weights.
ODDS = 48
#: Gates of the long context (what it has seen, and whether both bits) times those of the short one.
GATES = 64
#: Bytes of a word spelled with one set of weights.
SEGMENT = 64
SPELL_BITS = 20
#: Rows that a worker gets at once: they are texts, or what partitions are asked and answer, up to megabytes each.
LARGE_ROWS = 128


def words_of(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and splits at white space (space, U+0009 to U+000D)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


@dataclass
class Code:
    """Huffman code of the symbols: path[first[s]:first[s + 1]] holds, for each decision of s, 2 * node + bit; leaf[s] is s's place from left to right; bits and length are
    by place: the code from the top bit down; first_at too is by place."""

    first: np.ndarray
    path: np.ndarray
    leaf: np.ndarray
    bits: np.ndarray
    length: np.ndarray
    first_at: np.ndarray


def code_lengths(weights: np.ndarray) -> np.ndarray:
    """Lengths of the Huffman code for symbols of these weights (at least two); ties are broken by place."""
    n = len(weights)
    heap = [(int(w), i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    parent = [0] * (2 * n - 1)
    for node in range(n, 2 * n - 1):
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x] = parent[y] = node
        heapq.heappush(heap, (a + b, node))
    depth = [0] * (2 * n - 1)
    for i in range(2 * n - 3, -1, -1):
        depth[i] = depth[parent[i]] + 1
    return np.array(depth[:n], np.uint8)


def code_of(lengths: np.ndarray) -> Code:
    """The canonical code of these lengths: leaves stand by length, then by symbol."""
    n, length = len(lengths), lengths.astype(np.int64)
    order = np.argsort(length, kind="stable")
    leaf = np.empty(n, np.int64)
    leaf[order] = np.arange(n)
    of = length[order]
    widths = np.uint64(1) << (64 - of).astype(np.uint64)
    bits = np.cumsum(widths) - widths  # from the top bit down; the sum of all is 2^64, that is 0
    first = np.r_[0, np.cumsum(length)]
    path, nodes = np.empty(int(first[-1]), np.int32), 0
    for k in range(int(of[-1])):
        here = np.searchsorted(of, k, side="right")  # leaves from here on lie deeper than k
        above = bits[here:] >> np.uint64(64 - k) if k else np.zeros(n - here, np.uint64)
        node = np.cumsum(np.r_[0, above[1:] != above[:-1]]) + nodes
        nodes = int(node[-1]) + 1
        path[first[order[here:]] + k] = 2 * node + (bits[here:] >> np.uint64(63 - k) & np.uint64(1)).astype(np.int64)
    return Code(first, path, leaf, bits, of, first[order])


def step_bounds(place: np.ndarray) -> np.ndarray:
    """The number of refinements before each place of a text."""
    return (place + STEP - FIRST_STEP) // STEP


def small(n: np.ndarray) -> np.ndarray:
    """Counts in a byte: exact below 128, then in steps of a twelfth of a doubling."""
    n = np.asarray(n, np.float64)
    return np.where(n < 128, n, np.minimum(255, 128 + np.rint(12 * np.log2(np.maximum(n, 128) / 128)))).astype(np.uint8)


def unsmall() -> np.ndarray:
    """The count that each byte of small() stands for."""
    b = np.arange(256.0)
    return np.where(b < 128, b, 128 * 2 ** ((b - 128) / 12))


def state(n: np.ndarray) -> np.ndarray:
    return STATES[np.minimum(n, 100)]


def packed(*arrays: np.ndarray) -> bytes:
    """Integer arrays, byte by byte of their elements, compressed; the bytes that are 0 everywhere are left out."""
    import pyarrow as pa

    head, parts = [len(arrays)], []
    for a in arrays:
        top = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        head += [len(a), top]
        parts.append(np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :top].T).tobytes())
    raw = b"".join(parts)
    return np.array([*head, len(raw)], "<i8").tobytes() + pa.compress(raw, "zstd", asbytes=True)


def unpacked(data: bytes) -> list[np.ndarray]:
    """The arrays of packed(), as unsigned 64-bit integers (as bytes where one byte suffices)."""
    import pyarrow as pa

    k = int(np.frombuffer(data, "<i8", 1)[0])
    head = np.frombuffer(data, "<i8", 2 * k + 2).tolist()
    raw = np.frombuffer(pa.decompress(memoryview(data)[8 * (2 * k + 2) :], head[-1], "zstd"), np.uint8) if head[-1] else np.zeros(0, np.uint8)
    out, at = [], 0
    for n, top in zip(head[1:-1:2], head[2:-1:2], strict=True):
        planes = raw[at : at + n * top].reshape(top, n)
        at += n * top
        if top == 1:
            out.append(planes[0])
        else:
            whole = np.zeros((n, 8), np.uint8)
            whole[:, :top] = planes.T
            out.append(whole.view("<u8").ravel())
    return out


@dataclass
class Alphabet:
    """What is broadcast of the symbols: the frequent words by falling count, one space between two; every symbol's learning count and code length; the number of partitions of contexts."""

    words: bytes
    counts: np.ndarray
    lengths: np.ndarray
    parts: int

    def coder(self) -> Coder:
        return Coder({w: FIRST_WORD + i for i, w in enumerate(self.words.split())}, code_of(self.lengths), self.parts)


@dataclass
class Coder:
    """What turns texts into symbols and pairs: the frequent words, the code, and the number of partitions of contexts."""

    words: dict[bytes, int]
    code: Code
    parts: int


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@dataclass
class Chunk:
    """Texts as symbols: their first symbols, the symbols, and the words behind RARE in order."""

    starts: np.ndarray
    symbols: np.ndarray
    rare: list[bytes]

    def classes(self) -> np.ndarray:
        """By symbol: the short context before it."""
        s, n = self.symbols, len(self.symbols)
        place = np.arange(n)
        told = np.maximum.accumulate(np.where((s >= FIRST_WORD) & (s < FIRST_WORD + CLASSES - 1), place, -1))
        told = np.r_[-1, told[:-1]]
        first = np.repeat(self.starts, np.diff(np.r_[self.starts, n]))
        return np.where(told >= first, s[np.maximum(told, 0)] - FIRST_WORD + 1, 0)

    def pairs(self, coder: Coder) -> tuple[np.ndarray, np.ndarray]:
        """Partition and key of each symbol's (context, symbol) pair, then of each other word's (context, word) pair. The context is the two words before, and the third if
        both are so frequent that they tell little."""
        s = self.symbols
        at = np.flatnonzero(s == RARE)
        crc = np.fromiter(map(zlib.crc32, self.rare), np.uint64, len(self.rare))
        ids = s.astype(np.uint64) + np.uint64(1)
        ids[at] = crc | np.uint64(1 << 40)
        ids = _mixed(ids)
        often = (s >= FIRST_WORD) & (s < FIRST_WORD + CLASSES - 1)
        back, much = [], []
        x, o = ids, often
        for _ in range(3):
            x, o = np.r_[np.uint64(0), x[:-1]], np.r_[False, o[:-1]]
            x[self.starts], o[self.starts] = 0, False
            back.append(x)
            much.append(o)
        h = _mixed(back[0] + np.uint64(3)) ^ (back[1] * np.uint64(0xD6E8FEB86659FD93))
        h = np.where(much[0] & much[1], h + back[2] * np.uint64(0xA0761D6478BD642F), h)
        h = _mixed(h)
        part = ((h >> np.uint64(32)) * np.uint64(coder.parts) >> np.uint64(32)).astype(np.int64)
        key = (h & np.uint64(0xFFFFFFFF)) << np.uint64(LOW)
        own = key | coder.code.leaf[s].astype(np.uint64)
        other = key[at] | np.uint64(RARE_BIT) | (crc & np.uint64(RARE_BIT - 1))
        return np.r_[part, part[at]], np.r_[own, other]


def distinct_pairs(part: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Partitions present, the bounds of each one's run of sorted distinct keys, all these keys, and the place of each given pair among them."""
    order = np.argsort(part, kind="stable")
    present, first = np.unique(part[order], return_index=True)
    keys, bounds, where = [], [0], np.empty(len(part), np.int64)
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=True):
        mine = order[lo:hi]
        kinds, inverse = np.unique(key[mine], return_inverse=True)
        where[mine] = inverse + bounds[-1]
        keys.append(kinds)
        bounds.append(bounds[-1] + len(kinds))
    return present, np.array(bounds), np.concatenate(keys) if keys else np.zeros(0, np.uint64), where


def chunks(batches, words: dict[bytes, int], most: int = CHUNK):
    """Chunks of whole texts, about `most` symbols each, with the slices (batch, first row, rows) that they hold."""
    sizes, symbols, rare, slices, total = [], [], [], [], 0

    def out():
        return Chunk(np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64), np.concatenate(symbols), rare), slices

    for b in batches:
        lo = 0
        for i, t in enumerate(b.column("text").to_pylist()):
            w = words_of(t)
            s = np.fromiter(chain(map(words.get, w, repeat(RARE)), (END,)), np.int32, len(w) + 1)
            rare += [w[j] for j in np.flatnonzero(s == RARE).tolist()]
            symbols.append(s)
            sizes.append(len(s))
            total += len(s)
            if total >= most:
                slices.append((b, lo, i + 1 - lo))
                yield out()
                sizes, symbols, rare, slices, total, lo = [], [], [], [], 0, i + 1
        if lo < b.num_rows:
            slices.append((b, lo, b.num_rows - lo))
    if sizes:
        yield out()


def paths(keys: np.ndarray, counts: np.ndarray, code: Code, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the learning texts hold on each pair's path. keys: a partition's sorted distinct pairs, counts: their learning counts, odds: order 0's by decision as in code.path.

    Returns for each pair a number of bytes and, concatenated, these: for a symbol the counts (as small() has them) at its path's nodes in its context from the root to the leaf, up to the first 0; one byte where
    the context has no other symbol, none where it is unknown. For another word: the context's count of such words, of those the count that agrees with whether this is the context's most frequent one, and that. Third: over
    all nodes on learning paths, how often each (order-0 odds, own count, other count) came, each occurrence seen without itself.
    """
    low = (keys & np.uint64((1 << LOW) - 1)).astype(np.int64)
    context = keys >> np.uint64(LOW)
    gathered = np.zeros(ODDS * N_STATES * N_STATES)
    size = np.zeros(len(keys), np.int64)
    pieces: list[tuple[np.ndarray, np.ndarray]] = []

    def runs(x):
        start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
        return start, np.diff(np.r_[start, len(x)])

    def gather(z, own, other, times):
        nonlocal gathered
        cell = np.clip(np.floor(2 * z) + ODDS // 2, 0, ODDS - 1).astype(np.int64) * N_STATES + state(own)
        gathered += np.bincount(cell * N_STATES + state(other), times, len(gathered))

    a = np.flatnonzero(low < RARE_BIT)
    start, kinds = runs(context[a])
    n = counts[a]
    total = np.repeat(np.add.reduceat(n, start), kinds) if len(a) else n
    alone = np.repeat(kinds, kinds) == 1
    one = alone & (n > 0)
    size[a[one]] = 1
    pieces.append((a[one], small(n[one])))
    again = np.flatnonzero(alone & (n > 1))
    if len(again):
        leaf = low[a[again]]
        steps = code.length[leaf]
        place = np.arange(int(steps.sum())) + np.repeat(code.first_at[leaf] - np.r_[0, np.cumsum(steps)[:-1]], steps)
        own = np.repeat(n[again], steps)
        gather(odds[place], own - 1, np.zeros_like(own), own)
    many = np.flatnonzero(~alone & (total > 0))
    if len(many):
        leaf, mine, of = low[a[many]], n[many], context[a[many]]
        bits, steps = code.bits[leaf], code.length[leaf]
        symbol_first = code.first_at[leaf]
        apart = bits[1:] ^ bits[:-1]
        shared = np.r_[-1, np.where(of[1:] != of[:-1], -1, 63 - np.floor(np.log2(np.maximum(apart, np.uint64(1)).astype(np.float64))).astype(np.int64))]
        upto = np.r_[0, np.cumsum(mine)]
        deepest = int(steps.max())
        table = np.zeros((len(many), deepest + 1), np.uint8)
        before = None
        for k in range(deepest + 1):
            begin = np.flatnonzero(shared < k)  # one run of equal first k decisions each
            ends = np.r_[begin[1:], len(many)]
            held_here = upto[ends] - upto[begin]
            table[:, k] = np.repeat(small(held_here), ends - begin)
            if k:
                above = before[begin]
                real = (held_here > 0) & (above > 1) & (steps[begin] >= k)
                x, y = held_here[real], above[real]
                gather(odds[symbol_first[begin[real]] + k - 1], x - 1, y - x, x)
            before = np.repeat(held_here, ends - begin)
        valid = np.arange(deepest + 1) <= steps[:, None]
        valid[:, 1:] &= table[:, :-1] > 0
        size[a[many]] = valid.sum(1)
        pieces.append((np.repeat(a[many], size[a[many]]), table[valid]))
    b = np.flatnonzero(low >= RARE_BIT)
    if len(b):
        start, kinds = runs(context[b])
        n = counts[b]
        total = np.repeat(np.add.reduceat(n, start), kinds)
        top = np.repeat(np.maximum.reduceat(n, start), kinds)
        group = np.repeat(np.arange(len(start)), kinds)
        best = np.flatnonzero(n == top)
        best = best[np.unique(group[best], return_index=True)[1]]
        is_best = np.zeros(len(b), bool)
        is_best[best] = True
        known = total > 0
        size[b[known]] = 3
        told = np.stack([small(total), small(np.where(is_best, top, total - top)), is_best.astype(np.uint8)], 1)[known]
        pieces.append((np.repeat(b[known], 3), told.ravel()))
    at, data = np.concatenate([p for p, _ in pieces]), np.concatenate([d for _, d in pieces])
    return size, data[np.argsort(at, kind="stable")], gathered


@dataclass
class Model:
    coder: Coder
    #: Order 0's log-odds of each decision as taken, in the order of the code's path.
    odds: np.ndarray
    #: By short context and node: log-odds of bit 1 times 256, then two bits of how much it has seen.
    short: np.ndarray
    #: By symbol: learning count; 0 for what isn't a token.
    counts: np.ndarray
    train_tokens: int
    kinds: int
    #: Share of words that the corpus knows among those that aren't frequent.
    known: float
    #: By two bytes of counts (in all, as taken): the long context's log-odds and its gate, 0 for none; the first weights of both contexts by gate.
    long: np.ndarray
    gate: np.ndarray
    weights: tuple[np.ndarray, np.ndarray]

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.train_tokens + 0.5 * (self.kinds + 1)))

    def scores(self, chunk: Chunk, size: np.ndarray, data: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural log of the probability of each text's symbols, and which of the other words are left to code. size, data: what paths() gives for the chunk's distinct pairs, where: each pair's place."""
        code, n = self.coder.code, len(chunk.symbols)
        offset = np.r_[0, np.cumsum(size)[:-1]]
        data = np.r_[data, np.uint8(0)]
        offset, size = np.where(size > 0, offset, len(data) - 1), np.maximum(size, 1)  # an unknown context has a count of 0
        text = np.repeat(np.arange(len(chunk.starts)), np.diff(np.r_[chunk.starts, n]))
        short = chunk.classes() * self.short.shape[1]
        step = step_bounds(np.arange(n) - chunk.starts[text])
        rare = np.full(n, -1)
        rare[np.flatnonzero(chunk.symbols == RARE)] = np.arange(len(chunk.rare))
        left = np.ones(len(chunk.rare), bool)
        out = np.zeros(len(chunk.starts))
        entries = self.short.ravel()
        groups = np.searchsorted(chunk.starts, np.arange(0, n, GROUP))  # texts that go on together
        groups = np.unique(np.r_[groups[groups < len(chunk.starts)], len(chunk.starts)])
        for t0, t1 in zip(groups[:-1].tolist(), groups[1:].tolist(), strict=True):
            first, last = int(chunk.starts[t0]), int(chunk.starts[t1]) if t1 < len(chunk.starts) else n
            order = first + np.argsort(step[first:last], kind="stable")
            bounds = np.r_[0, np.cumsum(np.bincount(step[first:last]))].tolist()
            w1, w2 = (np.tile(w, t1 - t0) for w in self.weights)
            w3, total = np.ones(t1 - t0, np.float32), np.zeros(t1 - t0)
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                now = order[lo:hi]
                s, mine, pair = chunk.symbols[now], text[now] - t0, where[now]
                begin = code.first[s]
                many = code.first[s + 1] - begin
                of = np.repeat(np.arange(len(now)), many)
                depth = np.arange(len(of)) - (np.cumsum(many) - many)[of]
                place = begin[of] + depth
                z, taken = self.odds[place], code.path[place]
                e = entries[short[now][of] + (taken >> 1)]
                x1 = (e >> 2).astype(np.float32)
                x1 *= ((taken & 1) * np.float32(1 / 128) - np.float32(1 / 256)).astype(np.float32)
                end, at = (size[pair] - 1)[of], offset[pair][of]
                seen = data[at + np.minimum(depth, end)].astype(np.uint16)
                depth += 1
                seen <<= 8
                seen |= data[at + np.minimum(depth, end)]
                gate = self.gate[seen]
                d2 = self.long[seen]
                d2 -= x1
                d2 *= gate > 0
                x1 -= z
                here = (mine * GATES)[of]
                here += (gate << 2) | (e & 3).astype(np.uint8)
                z = z + w1[here] * x1
                z += w2[here] * d2
                np.clip(z, -14, 14, out=z)
                np.exp(z, out=z)
                z += 1  # 1 / z is now the probability of the other bit
                np.divide(1, z, out=z)
                total += np.bincount(mine[of], np.log1p(-z), len(total))
                z *= np.float32(RATE)
                w1 += np.bincount(here, z * x1, len(w1)).astype(np.float32)
                w2 += np.bincount(here, z * d2, len(w2)).astype(np.float32)
                # other words: is it the one that the context saw most?
                other = now[rare[now] >= 0]
                pair = where[n + rare[other]]
                told = size[pair] == 3
                other, pair = other[told], pair[told]
                if len(other):
                    at, mine = offset[pair], text[other] - t0
                    x = self.long[data[at].astype(np.uint16) << 8 | data[at + 1]]
                    z = 1 / (1 + np.exp(np.clip(w3[mine] * x, -14, 14)))
                    total += np.bincount(mine, np.log1p(-z), len(total))
                    w3 += np.bincount(mine, RATE * z * x, len(w3)).astype(np.float32)
                    left[rare[other[data[at + 2] == 1]]] = False
            out[t0:t1] = total
        return out, left


def long_context(gathered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From what paths() gathered over all partitions: log-odds and gate by two bytes of counts, and the first weight of the long context by gate.

    An occurrence with `own` others on its side and `other` on the other one says how often a bit of such counts comes; by symmetry the share is T[own, other] of T[own, other] + T[other, own]. Large
    counts speak for themselves.
    """
    seen = gathered.reshape(ODDS, N_STATES, N_STATES)
    t = seen.sum(0) + 0.4
    by_state = np.log(t / t.T)
    n = unsmall()
    total, own = np.meshgrid(n, n, indexing="ij")
    other = np.maximum(total - own, 0)
    i, j = state(own.astype(np.int64)), state(other.astype(np.int64))
    own_odds = np.log((own + 0.4) / (other + 0.4))
    odds = np.where(total < 31, by_state[i, j], own_odds)

    def gate_of(total, least):
        return np.where(total < 1, 0, 1 + 2 * np.searchsorted([2, 3, 5, 10, 31, 300], total, side="right") + (least > 0))

    gate = gate_of(total, np.minimum(own, other))
    # first weights: the best of a few for what was gathered
    middle = np.array([0, 1, 2, 3, 4.5, 7, 11, 20, 50, 200])
    a, b = np.meshgrid(middle, middle, indexing="ij")
    cell_gate = gate_of(a + b, np.minimum(a, b))
    x = np.where(a + b < 31, by_state, np.log((a + 0.4) / (b + 0.4)))
    z = ((np.arange(ODDS) - ODDS // 2) / 2 + 0.25)[:, None, None]
    tried = np.linspace(0, 1.2, 25)
    fit = np.array([[(seen * -np.logaddexp(0, -(z + w * (x - z))))[:, cell_gate == g].sum() for w in tried] for g in range(GATES // 4)])
    first = np.where([seen[:, cell_gate == g].sum() > 0 for g in range(GATES // 4)], tried[fit.argmax(1)], 0.5)
    return odds.ravel().astype(np.float32), gate.ravel().astype(np.uint8), np.repeat(first, 4).astype(np.float32)


@dataclass
class Learned:
    """What is broadcast of the corpus: the alphabet, packed learning counts of the symbols for each short context, and what is known of long ones and of words."""

    alphabet: Alphabet
    by_class: list[bytes]
    long: np.ndarray
    gate: np.ndarray
    first: np.ndarray
    train_tokens: int
    kinds: int
    known: float

    def model(self) -> Model:
        coder = Coder({}, code_of(self.alphabet.lengths), self.alphabet.parts)
        odds, short = short_table(coder.code, self.alphabet.counts, (unpacked(x)[0] for x in self.by_class), len(self.by_class))
        counts = self.alphabet.counts - 1
        counts[RARE] = 0
        return Model(coder, odds, short, counts, self.train_tokens, self.kinds, self.known, self.long, self.gate, (np.ones(GATES, np.float32), self.first))


def short_table(code: Code, counts: np.ndarray, by_class, n_classes: int, prior: float = 6.0) -> tuple[np.ndarray, np.ndarray]:
    """Order 0's odds of each decision as taken, and the short contexts' entries by node. counts: by symbol, 1 at least; by_class: those of each short context."""
    n = len(code.leaf)
    node, bit = code.path >> 1, code.path & 1
    leaf = np.repeat(code.leaf, np.diff(code.first))
    lo, mid, hi = np.full(n - 1, n), np.full(n - 1, n), np.zeros(n - 1, np.int64)
    np.minimum.at(lo, node, leaf)
    np.maximum.at(hi, node, leaf + 1)
    np.minimum.at(mid, node[bit == 1], leaf[bit == 1])
    order = np.argsort(code.leaf)

    def sides(c):
        upto = np.r_[0, np.cumsum(c[order])]
        return upto[mid] - upto[lo], upto[hi] - upto[mid]

    zero, one = sides(counts.astype(np.float64))
    p = (one + 0.4) / (zero + one + 0.8)
    odds = np.log(p / (1 - p))
    out = np.empty((n_classes, n - 1), np.int16)
    for k, c in enumerate(by_class):
        zero, one = sides(c.astype(np.float64))
        x = np.log((one + prior * p) / (zero + prior * (1 - p)))
        out[k] = (np.rint(np.clip(x, -31, 31) * 256).astype(np.int32) << 2) | np.searchsorted([3, 30, 300], zero + one, side="right")
    return (odds[node] * (2 * bit - 1)).astype(np.float32), out


@dataclass
class Speller:
    """Bits of a new word's bytes from the one, two and three bytes before, learned from the distinct words that aren't frequent; a space ends a word. counts: of each order's slots, in
    bytes of small(), bit 0 and bit 1 in turn."""

    counts: list[np.ndarray]

    @staticmethod
    def slots(words: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """For each bit of each word and its end: the bit, its slot in each order's table; and each word's number of bytes, the end included."""
        size = np.array([len(w) + 1 for w in words])
        byte = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.uint32)
        back, x = [], byte
        starts = np.r_[0, np.cumsum(size)[:-1]]
        for _ in range(3):
            x = np.r_[np.uint32(0), x[:-1]]
            x[starts] = 0
            back.append(x)
        shifts = np.arange(7, -1, -1, dtype=np.uint32)
        bit = ((byte[:, None] >> shifts) & 1).astype(np.uint8).ravel()
        node = ((byte[:, None] | 256) >> (shifts + np.uint32(1))).ravel()
        one = np.repeat(back[0] << np.uint32(8), 8) | node
        two, three = np.repeat(back[0] | back[1] << np.uint32(8), 8), np.repeat(back[0] | back[1] << np.uint32(8) | back[2] << np.uint32(16), 8)
        shift = np.uint32(32 - SPELL_BITS)
        hashed = [((x * np.uint32(0x9E3779B1)) ^ (node * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35) >> shift for x in (two, three)]
        return bit, [one, *hashed], size

    def log10(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each word."""
        if not words:
            return np.zeros(0)
        bit, slots, size = self.slots(words)
        odds, p, n = [], None, unsmall()
        for table, s in zip(self.counts, slots, strict=True):
            n0, n1 = (n[table[2 * s.astype(np.int64) + x]] for x in (0, 1))
            p = np.clip((n1 + 0.4) / (n0 + n1 + 0.8) if p is None else (n1 + 2 * p) / (n0 + n1 + 2), 1e-6, 1 - 1e-6)
            odds.append(np.log(p / (1 - p)) * (2.0 * bit - 1))
        # words go on side by side, a byte at a time; a long one in segments
        of = np.repeat(np.arange(len(words)), size)
        place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        segment = np.cumsum((place % SEGMENT) == 0) - 1
        turn = place % SEGMENT
        order = np.argsort(turn, kind="stable")
        bounds = np.r_[0, np.cumsum(np.bincount(turn))].tolist()
        weights = np.ones((segment[-1] + 1, 2))
        out = np.zeros(len(words))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            now = order[lo:hi]
            at = (now[:, None] * 8 + np.arange(8)).ravel()
            mine = np.repeat(segment[now], 8)
            d2, d3 = odds[1][at] - odds[0][at], odds[2][at] - odds[1][at]
            z = np.clip(odds[0][at] + weights[mine, 0] * d2 + weights[mine, 1] * d3, -14, 14)
            miss = 1 / (1 + np.exp(z))
            out += np.bincount(np.repeat(of[now], 8), np.log1p(-miss), len(out))
            for k, d in enumerate((d2, d3)):
                weights[:, k] += np.bincount(mine, RATE * miss * d, len(weights))
        return out / np.log(10)


def word_counts(rows: DataFrame) -> DataFrame:
    """word, c: exact counts of the words of rows(text). Each task adds up what it reads before the shuffle, in pieces of bounded size."""

    def run(batches):
        import pyarrow as pa

        def out(counts):
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

        counts: Counter = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                counts.update(words_of(t))
                if len(counts) > 400_000:
                    yield out(counts)
                    counts = Counter()
        if counts:
            yield out(counts)

    return rows.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _summed(rows: DataFrame, schema: str, key: str, value: str) -> DataFrame:
    """rows(key, value: packed array) with the arrays of each key added up, 64-bit integers."""

    def add(batches):
        import pyarrow as pa

        sums: dict = {}
        for b in batches:
            for k, data in zip(b.column(key).to_pylist(), b.column(value), strict=True):
                (x,) = unpacked(data.as_buffer())
                sums[k] = sums[k] + x if k in sums else x.astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([packed(x) for x in sums.values()], pa.binary())], [key, value])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key).mapInArrow(add, schema)


def speller(words: DataFrame, kinds: int) -> Speller:
    """Learned from the distinct words of words(word), one row each, kinds in all or fewer."""
    sizes, block = [1 << 16, 1 << SPELL_BITS, 1 << SPELL_BITS], 1 << 15
    first = np.r_[0, np.cumsum([2 * n // block for n in sizes])]

    def count(batches):
        import pyarrow as pa

        sums = [np.zeros(2 * n, np.int64) for n in sizes]
        for b in batches:
            for lo in range(0, b.num_rows, 20_000):
                bit, slots, _ = Speller.slots(b.column("word").slice(lo, 20_000).to_pylist())
                for n, s in zip(sums, slots, strict=True):
                    n += np.bincount(2 * s.astype(np.int64) + bit, minlength=len(n))
        for k, n in enumerate(sums):
            some = [(int(first[k]) + i, x) for i, x in enumerate(n.reshape(-1, block)) if x.any()]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int32()), pa.array([packed(x) for _, x in some], pa.binary())], ["block", "n"])

    # each task sends its whole tables, so they are few, but none reads more than about a million words
    few = words.coalesce(max(words.sparkSession.sparkContext.defaultParallelism, kinds >> 20))
    sums = np.zeros((int(first[-1]), block), np.uint8)
    for r in _summed(few.mapInArrow(count, "block int, n binary"), "block int, n binary", "block", "n").toLocalIterator():
        sums[r.block] = small(unpacked(bytes(r.n))[0])
    return Speller([x.ravel() for x in np.split(sums, first[1:-1])])


def frequent_words(counts: DataFrame, most_words: int) -> list[tuple[bytes, int]]:
    """All words with at least the least count, 2 or more, that keeps them within most_words, by falling count."""
    least, have = None, 0
    by_count = {r.k: (r.n, r.c) for r in counts.where("c >= 2").groupBy(F.floor(F.log2("c") * 16).alias("k")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect()}
    for k in sorted(by_count, reverse=True):
        have += by_count[k][0]
        if have > most_words:
            break
        least = by_count[k][1]
    return [] if least is None else sorted(((bytes(r.word), r.c) for r in counts.where(F.col("c") >= least).collect()), key=lambda x: (-x[1], x[0]))


#: Kinds of rows on their way to the partitions and back.
ASKED, TEXTS, CLASS_COUNTS, ANSWER, GATHERED = range(5)


def _ask(rows: DataFrame, sent, key: str, schema: str) -> DataFrame:
    """Chunks of rows(id, text, learn): each one's texts, its distinct pairs for each partition, and each task's learning counts by short context and symbol."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        coder = held(("coder", key), lambda: sent.value.coder())
        n_symbols = len(coder.code.leaf)
        by_class = np.zeros(CLASSES * n_symbols, np.uint32)
        task, k, names = TaskContext.get().partitionId(), 0, [c.split()[0] for c in schema.split(", ")]

        def out(kind, dest, chunk, data, ids=None, learn=None, size=None):
            n = len(dest)
            some = [pa.array([x], t) if x is not None else pa.nulls(n, t) for x, t in ((ids, pa.list_(id_type)), (learn, pa.list_(pa.bool_())), (size, pa.list_(pa.int64())))]
            return pa.RecordBatch.from_arrays([pa.array(dest, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array(chunk, pa.int64()), pa.array(data, pa.binary()), *some], names)

        id_type = None
        for c, slices in chunks(batches, coder.words):
            ids = pa.chunked_array([b.column("id").slice(lo, n) for b, lo, n in slices]).combine_chunks()
            learn = pa.chunked_array([b.column("learn").slice(lo, n) for b, lo, n in slices]).to_numpy()
            size = pa.chunked_array([pc.fill_null(pc.binary_length(b.column("text").slice(lo, n)), 0).cast(pa.int64()) for b, lo, n in slices]).to_pylist()
            id_type = ids.type
            many = np.diff(np.r_[c.starts, len(c.symbols)])
            by_symbol = np.repeat(learn, many)
            cells, times = np.unique((c.classes() * n_symbols + c.symbols)[by_symbol], return_counts=True)
            by_class[cells] += times.astype(np.uint32)
            part, pairs = c.pairs(coder)
            present, bounds, kinds, where = distinct_pairs(part, pairs)
            times = np.bincount(where, np.r_[by_symbol, by_symbol[c.symbols == RARE]], len(kinds)).astype(np.int64)
            chunk = task << 24 | k
            k += 1
            for lo in range(0, len(present), 64):  # a few blobs at a time
                mine = list(zip(present[lo : lo + 64].tolist(), bounds[lo:].tolist(), bounds[lo + 1 :].tolist(), strict=False))
                yield out(ASKED, [p for p, _, _ in mine], [chunk] * len(mine), [packed(kinds[x:y], times[x:y]) for _, x, y in mine])
            texts = packed(many, c.symbols.astype(np.int64))
            words = pa.compress(spelled := b" ".join(c.rare), "zstd", asbytes=True)
            data = np.array([len(texts), len(spelled)], "<i8").tobytes() + texts + words
            yield out(TEXTS, [chunk * 2_654_435_761 % coder.parts], [chunk], [data], ids, learn.tolist(), size)
        id_type = id_type or pa.null()
        wide = 1 << 16
        for at in range(0, len(by_class), wide):
            if (x := by_class[at : at + wide]).any():
                yield out(CLASS_COUNTS, [at // wide % coder.parts], [at // wide], [packed(x)])

    return rows.mapInArrow(run, schema)


def _answered(asked: DataFrame, parts: int, sent, key: str, schema: str) -> DataFrame:
    """What _ask() gave, by partition: the pairs answered for each chunk, the class counts added up, what paths() gathered, and the texts as they are."""

    def run(batches):
        import pyarrow as pa

        code, z = held(("answers", key), lambda: (code := code_of(sent.value.lengths), short_table(code, sent.value.counts, [], 0)[0]))
        blobs, classes, names = [], {}, [c.split()[0] for c in schema.split(", ")]
        dest, id_types = 0, None

        def out(kind, chunk, data):
            n = len(chunk)
            return pa.RecordBatch.from_arrays([pa.array([dest] * n, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array(chunk, pa.int64()), pa.array(data, pa.binary()), *[pa.nulls(n, t) for t in id_types]], names)

        for b in batches:
            id_types = [b.column(c).type for c in ("ids", "learn", "size")]
            kind = b.column("kind").to_numpy()
            if (kind == TEXTS).any():
                yield b.filter(pa.array(kind == TEXTS))
            for i in np.flatnonzero(kind != TEXTS).tolist():
                chunk, data = b.column("chunk")[i].as_py(), b.column("data")[i].as_py()
                dest = b.column("dest")[i].as_py()
                if kind[i] == CLASS_COUNTS:
                    (x,) = unpacked(data)
                    classes[chunk] = classes[chunk] + x if chunk in classes else x.astype(np.int64)
                else:
                    blobs.append((chunk, data))
        for chunk, x in classes.items():
            yield out(CLASS_COUNTS, [chunk], [packed(x)])
        if not blobs:
            return
        keys, times = zip(*(unpacked(d) for _, d in blobs), strict=True)
        sizes = [len(k) for k in keys]
        of = [chunk for chunk, _ in blobs]
        del blobs
        keys, times = np.concatenate(keys), np.concatenate(times)  # the parts are free from here on
        kinds, where = np.unique(keys.astype(np.uint64, copy=False), return_inverse=True)
        del keys
        counts = np.bincount(where, times, len(kinds)).astype(np.int64)
        where = where.astype(np.int32)
        del times
        # whole contexts together, some at a time
        fresh = np.flatnonzero(np.r_[True, kinds[1:] >> np.uint64(LOW) != kinds[:-1] >> np.uint64(LOW)])
        cuts = np.unique(np.r_[fresh[np.searchsorted(fresh, np.arange(0, len(kinds), 200_000), side="right") - 1], len(kinds)])
        found = [paths(kinds[lo:hi], counts[lo:hi], code, z) for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        size, data, gathered = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), sum(f[2] for f in found)
        del found, kinds, counts
        first = np.r_[0, np.cumsum(size)]
        at = 0
        for chunk, n in zip(of, sizes, strict=True):
            mine = where[at : at + n]  # ascending
            at += n
            many = size[mine]
            place = np.arange(int(many.sum())) + np.repeat(first[mine] - (np.cumsum(many) - many), many)
            yield out(ANSWER, [chunk], [packed(many, data[place].astype(np.uint64))])
        yield out(GATHERED, [dest], [gathered.astype("<f8").tobytes()])

    return asked.repartitionById(parts, "dest").mapInArrow(run, schema)


def language_scores(docs: DataFrame, *, learns: Column | None = None, id_col: str = "doc_id", text_col: str = "text", most_words: int = 1 << 18) -> DataFrame:
    """One row for each row of docs: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    learns: which rows to learn from, an expression on columns of docs (default: all); held_out is its opposite. Tokens are the words, then one end. base_score adds up
    log10((c + 0.5) / (N + 0.5 * (V + 1))); score is the mixing model's log10 probability of the text. A null text counts as empty: its end alone.
    bits_per_byte is null for an empty text. With nothing to learn from N is 0. Repeated rows are scored each; an empty table gives none. Only the named columns are read.
    most_words bounds what is broadcast; other words are joined.
    """
    spark = docs.sparkSession
    learns = F.lit(True) if learns is None else F.coalesce(learns, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), learns.alias("learn"))
    learning = rows.where("learn").select("text")
    counts = kept(word_counts(learning), "words", batch_rows=1024)
    texts = learning.count()
    total, vocabulary, once = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1)).first()
    frequent = frequent_words(counts, most_words)
    least = frequent[-1][1] if frequent else None
    others = counts if least is None else counts.where(F.col("c") < least)
    # leaving out one occurrence, a word of the least frequent count isn't frequent, and one seen once is new
    near = 0 if least is None else counts.where(F.col("c").between(2, least)).agg(F.sum("c")).first()[0] or 0
    rare_tokens = total - sum(c for _, c in frequent)
    weight = np.array([texts, rare_tokens, *[c for _, c in frequent]]) + 1
    parts = max(spark.sparkContext.defaultParallelism, -(-(total + texts) // PART))
    alphabet = Alphabet(b" ".join(w for w, _ in frequent), weight, code_lengths(weight), parts)
    spell = speller(others, vocabulary)

    key, context = uuid.uuid4().hex, spark.sparkContext
    sent = context.broadcast(alphabet)
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"dest int, kind int, chunk long, data binary, ids array<{id_type}>, learn array<boolean>, size array<long>"
    answers = kept(_answered(_ask(rows, sent, key, schema), parts, sent, key, schema), "answers", batch_rows=LARGE_ROWS)
    gathered = np.zeros(ODDS * N_STATES * N_STATES)
    by_class = np.zeros(CLASSES * len(weight), np.uint32)
    for r in answers.where(F.col("kind").isin(GATHERED, CLASS_COUNTS)).select("kind", "chunk", "data").toLocalIterator():
        if r.kind == GATHERED:
            gathered += np.frombuffer(bytes(r.data), "<f8")
        else:
            x = unpacked(bytes(r.data))[0]
            by_class[r.chunk << 16 : (r.chunk << 16) + len(x)] += x.astype(np.uint32)
    known = (near + 1) / (near + once + 2)
    model_sent = context.broadcast(Learned(alphabet, [packed(x) for x in by_class.reshape(CLASSES, -1)], *long_context(gathered), total + texts, vocabulary + (texts > 0), known))
    del by_class

    def run(batches):
        import pyarrow as pa

        model = held(("model", key), lambda: model_sent.value.model())

        def scored(head, told):
            chunk_id, data, ids, learn, size = head
            n_texts, n_words = np.frombuffer(data, "<i8", 2).tolist()
            many, symbols = (x.astype(np.int64) for x in unpacked(data[16 : 16 + n_texts]))
            rare = pa.decompress(data[16 + n_texts :], n_words, "zstd", asbytes=True).split(b" ") if n_words else []
            c = Chunk(np.r_[0, np.cumsum(many)[:-1]], symbols, rare)
            part, pairs = c.pairs(model.coder)
            order, bounds, kinds, where = distinct_pairs(part, pairs)
            got = [unpacked(told[p]) for p in order.tolist()]
            score, left = model.scores(c, np.concatenate([g[0] for g in got]).astype(np.int64), np.concatenate([g[1] for g in got]).astype(np.uint8), where)
            base = model.base(model.counts[symbols])
            base[symbols == RARE] = 0
            text = np.repeat(np.arange(len(many)), many)
            known = np.bincount(text, model.counts[symbols] > 0, len(many)).astype(np.int64)
            base = np.bincount(text, base, len(many))
            n_rare = np.bincount(text[symbols == RARE], minlength=len(many))
            words, times, misses, at = [], [], [], 0
            for n in n_rare.tolist():
                of: dict[bytes, list[int]] = {}
                for w, x in zip(rare[at : at + n], left[at : at + n].tolist(), strict=True):
                    y = of.setdefault(w, [0, 0])
                    y[0] += 1
                    y[1] += x
                at += n
                words.append(list(of))
                times.append([x for x, _ in of.values()])
                misses.append([x for _, x in of.values()])
            number = pa.array([f"{chunk_id}:{i}" for i in range(len(many))])
            lists = [pa.array(words, pa.list_(pa.binary())), *[pa.array(x, pa.list_(pa.int64())) for x in (times, misses)]]
            values = [pa.array(many), pa.array(known), pa.array(base), pa.array(score / np.log(10))]
            return pa.RecordBatch.from_arrays([number, ids, learn, size, *values, *lists], ["row", "id", "learn", "n_bytes", "n_tokens", "known", "base", "score", "words", "times", "misses"])

        head, told = None, {}
        for b in batches:
            for i in range(b.num_rows):
                if b.column("kind")[i].as_py() == TEXTS:  # comes first of its chunk
                    if head is not None:
                        yield scored(head, told)
                    head, told = (b.column("chunk")[i].as_py(), b.column("data")[i].as_py(), *[b.column(c)[i].values for c in ("ids", "learn", "size")]), {}
                else:
                    told[b.column("dest")[i].as_py()] = b.column("data")[i].as_py()
        if head is not None:
            yield scored(head, told)

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts)
    by_chunk = answers.where(F.col("kind").isin(TEXTS, ANSWER)).repartition(n, "chunk").sortWithinPartitions("chunk", "kind")
    scored = by_chunk.mapInArrow(run, f"row string, id {id_type}, learn boolean, n_bytes long, n_tokens long, known long, base double, score double, words array<binary>, times array<long>, misses array<long>")
    scored = kept(scored, "scored", batch_rows=LARGE_ROWS)
    # the words that no worker holds: their counts are joined, new ones are spelled, and what they add is summed by row
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times", "misses")).alias("x")).select("row", F.col("x.words").alias("word"), "x.times", "x.misses")
    spell_sent = context.broadcast(spell)
    share = float(np.log10(known / max(1, rare_tokens)))

    def other_words(batches):
        import pyarrow as pa

        speller = held(("speller", key), lambda: spell_sent.value)
        for b in batches:
            c = np.nan_to_num(b.column("c").to_numpy(zero_copy_only=False).astype(float))
            times, misses = b.column("times").to_numpy(), b.column("misses").to_numpy()
            add = np.zeros(len(c))
            add[c > 0] = np.log10(c[c > 0]) + share
            new = np.flatnonzero((c == 0) & (misses > 0))
            words = b.column("word").take(pa.array(new)).to_pylist()
            distinct = list(dict.fromkeys(words))
            cost = {}
            for lo in range(0, len(distinct), 4096):
                cost |= zip(distinct[lo : lo + 4096], speller.log10(distinct[lo : lo + 4096]).tolist(), strict=True)
            add[new] = [cost[w] for w in words]
            add[new] += np.log10(1 - known)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(np.where(c > 0, times, 0)), pa.array(times * model_base(c)), pa.array(misses * add)], ["row", "known", "base", "score"])

    floor = total + texts + 0.5 * (vocabulary + (texts > 0) + 1)

    def model_base(c):
        return np.log10((c + 0.5) / floor)

    found = rare.join(counts, "word", "left").mapInArrow(other_words, "row string, known long, base double, score double")
    more = found.groupBy("row").agg(F.sum("known").alias("more_known"), F.sum("base").alias("more_base"), F.sum("score").alias("more_score"))
    return (
        scored.drop("words", "times", "misses")
        .join(more, "row", "left")
        .select(
            F.col("id").alias(id_col),
            (~F.col("learn")).alias("held_out"),
            "n_tokens",
            (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
            F.lit(total + texts).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
            (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
            "n_bytes",
        )
        .withColumn("bits_per_byte", -F.col("score") * float(np.log2(10)) / F.nullif(F.col("n_bytes"), F.lit(0)))
    )
