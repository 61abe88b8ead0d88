"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

The chain's states are article and other. A block's features are the tags, classes, ids and
roles of its ancestors, its own element, its length, its share of link text, how it ends and
whether it is the first. Weights are trained on labelled pages (see html_pages) by the
likelihood's gradient, with sums over all chains by forward-backward, and pages are decoded
by Viterbi. The text is that of the article's blocks, joined by one space.

Null and empty pages, and pages without an article block, have the text '' and 0 characters; no
pages give no rows. Very long and faulty pages take time and memory in proportion to their length.
Repeated rows stay, each extracted for itself. Other columns of the input are not read.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices_of
from .html_blocks import blocks
from .html_pages import MARK, labelled_pages

TRAIN_PAGES, SEED, STEPS, RATE, RIDGE = 600, 11, 150, 0.3, 0.5


@dataclass
class Chain:
    """weights: of features for the state 1 (article); moves[a][b]: from state a to b; starts: of the first."""

    weights: dict[str, float]
    moves: list[list[float]]
    starts: list[float]

    def decode(self, scores: list[float]) -> list[int]:
        """The likeliest states of blocks with these scores for the state 1."""
        if not scores:
            return []
        (m00, m01), (m10, m11) = self.moves
        zero, one = self.starts[0], self.starts[1] + scores[0]
        back = []
        for s in scores[1:]:
            to_zero, to_one = zero + m00 < one + m10, zero + m01 < one + m11
            back.append((int(to_zero), int(to_one)))
            zero, one = (one + m10 if to_zero else zero + m00), (one + m11 if to_one else zero + m01) + s
        states = [int(one > zero)]
        for b in reversed(back):
            states.append(b[states[-1]])
        return states[::-1]

    def extract(self, page: str | None) -> str:
        found = list(blocks(page or "", self.weights.__contains__))
        states = self.decode([sum(map(self.weights.__getitem__, f)) for _, f in found])
        return " ".join(text for (text, _), s in zip(found, states) if s)


@functools.lru_cache(maxsize=1)
def trained(pages: int = TRAIN_PAGES, seed: int = SEED) -> Chain:
    """Fit by gradient steps with Adam's scaling on the log-likelihood less a ridge."""
    chains = [[(MARK in text, f) for text, f in blocks(p)] for p in labelled_pages(pages, seed)]
    chains = [c for c in chains if c]
    names = sorted({f for c in chains for _, fs in c for f in fs})
    index = {f: i for i, f in enumerate(names)}
    n, longest = len(chains), max(map(len, chains))
    row, feature = map(np.array, zip(*((i * longest + t, index[f]) for i, c in enumerate(chains) for t, (_, fs) in enumerate(c) for f in fs)))
    y = np.zeros((n, longest), np.int64)
    real = np.zeros((n, longest), bool)
    for i, c in enumerate(chains):
        y[i, : len(c)] = [label for label, _ in c]
        real[i, : len(c)] = True
    seen_moves = np.zeros((2, 2))
    both = real[:, 1:]
    np.add.at(seen_moves, (y[:, :-1][both], y[:, 1:][both]), 1)
    seen_starts = np.bincount(y[:, 0], minlength=2).astype(float)
    theta = np.zeros(len(names) + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w, moves, starts = theta[: len(names)], theta[-6:-2].reshape(2, 2), theta[-2:]
        score = np.zeros((n, longest, 2))
        score[..., 1] = np.bincount(row, weights=w[feature], minlength=n * longest).reshape(n, longest)
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = starts + score[:, 0]
        for t in range(1, longest):
            ahead[:, t] = np.where(real[:, t, None], score[:, t] + np.logaddexp.reduce(ahead[:, t - 1, :, None] + moves, axis=1), ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            behind[:, t] = np.where(real[:, t + 1, None], np.logaddexp.reduce(moves + (score[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2), 0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        state = np.exp(ahead + behind - total[:, None, None]) * real[..., None]
        pair = np.exp(ahead[:, :-1, :, None] + moves + (score + behind)[:, 1:, None, :] - total[:, None, None, None]) * both[..., None, None]
        miss = ((y == 1) - state[..., 1]) * real
        gradient = np.concatenate([np.bincount(feature, weights=miss.ravel()[row], minlength=len(names)), (seen_moves - pair.sum(axis=(0, 1))).ravel(), seen_starts - state[:, 0].sum(axis=0)]) - RIDGE * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Chain(dict(zip(names, theta.tolist())), theta[-6:-2].reshape(2, 2).tolist(), theta[-2:].tolist())


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    chain = pages.sparkSession.sparkContext.broadcast(trained())  # a few hundred weights

    def extracted(batches):
        for batch in batches:
            for lo, hi in slices_of(batch.column(2)):
                texts = [chain.value.extract(p.as_py()) for p in batch.column(2).slice(lo, hi - lo)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in (0, 1)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
