"""Block-max WAND against BM25 counted plainly for every passage and every piece."""

import math
from collections import Counter

import numpy as np
import pytest

from millrace.llm.decontamination import K1, PIECE, B, Index


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.9])
def test_every_piece_at_or_above_the_threshold_is_found(threshold):
    rng = np.random.default_rng(21)
    words = [f"w{i}" for i in range(600)]
    often = 1 / np.arange(1, 601) ** 1.1
    draw = lambda n: rng.choice(words, n, p=often / often.sum()).tolist()
    items = [draw(int(rng.integers(8, 150))) for _ in range(300)]
    index = Index([(i, " ".join(t)) for i, t in enumerate(items)], threshold)

    pieces = [t[lo : lo + PIECE] for t in items for lo in range(0, len(t), PIECE)]
    counts = [Counter(t) for t in pieces]
    holders = Counter(w for c in counts for w in c)
    mean = sum(map(len, pieces)) / len(pieces)

    def weight(w, p):
        idf = math.log(1 + (len(pieces) - holders[w] + 0.5) / (holders[w] + 0.5))
        return idf * counts[p][w] * (K1 + 1) / (counts[p][w] + K1 * (1 - B + B * len(pieces[p]) / mean))

    best = [sum(weight(w, p) for w in c) for p, c in enumerate(counts)]
    met = 0
    for _ in range(25):
        text = draw(int(rng.integers(0, 200)))
        for i in rng.integers(0, 300, 3):
            part = list(items[i])
            for j in rng.choice(len(part), len(part) // int(rng.integers(2, 9)), replace=False):
                part[j] = "unheard"
            text += [*part, *draw(int(rng.integers(0, 90)))]
        ids = np.array([index.terms.get(w, -1) for w in text], np.int64)
        got = {}
        for lo, blocks in index.passages(ids).items():
            here = np.unique(ids[lo : lo + 2 * PIECE])
            got.update({(lo, p): s for block in blocks for p, s in index.search(here[here >= 0].tolist(), block)})
        want = {}
        for lo in range(0, len(text), PIECE):
            held = set(text[lo : lo + 2 * PIECE])
            for p, c in enumerate(counts):
                score = sum(weight(w, p) for w in c if w in held) / best[p]
                if score >= threshold - 1e-9:
                    want[lo, p] = score
        assert got == pytest.approx(want)
        met += len(want)
    assert met
